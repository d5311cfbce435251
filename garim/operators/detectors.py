"""Detectors as declarative rules that compile to Catalyst expressions.

A rule has a pattern, a check of what it matched, a risk and a confidence. Rules of one label run in
passes; a later pass gives no span that clashes with one of an earlier pass. Nothing leaves the JVM and
nothing is shuffled; labels that are not asked for are not computed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garim.functions import checks as C
from garim.functions import spans as S
from garim.operators.dictionary import Terms
from garim.operators.name_context import Syllables, accumulated

INFO, LOW, MEDIUM, HIGH, CRITICAL = range(1, 6)
#: The day that dates are held against unless a caller names another: results don't change overnight.
AS_OF = "2025-01-01"

#: The rank of spans that a dictionary gave.
TERM_RANK = 900

Check = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    risk: int
    confidence: float
    keep: Check | None = None
    lead: int | None = None
    value: int = 0
    #: Confidence where `sure` doesn't hold.
    unsure: float | None = None
    sure: Check | None = None
    #: Confidence by the words around; `accumulated` then weighs what the text says of the same words elsewhere.
    score: Check | None = None
    #: Characters to leave out at the end of a match.
    trim: str = ""
    #: Whether a later pass must only not repeat a span, or not overlap one.
    exact: bool = False
    #: Names of `GATES` that a text with a match always passes.
    gate: str = "four"
    #: What the words around must be besides; left out for labels that are taken by their form alone.
    context: Check | None = None


#: Cheap tests that spare most texts most patterns. Each is made once for a text.
GATES: dict[str, Callable[[Column], Column]] = {
    "any": lambda t: t.isNotNull(),
    "digit": lambda t: t.rlike("[0-9]"),
    "four": lambda t: t.rlike("[0-9]{4}"),
    "hangul": lambda t: t.rlike("[가-힣]"),
    "at": lambda t: t.contains("@"),
    "colon": lambda t: t.contains(":"),
    "school": lambda t: t.rlike("[가-힣]|KAIST|POSTECH|UNIST|GIST"),
    "bank": lambda t: t.rlike("[가-힣]|IBK|KEB|KB|NH|SC|MG|EXIM|BOK|Sh"),
}


def keyword(words: tuple[str, ...], window: int) -> Check:
    """One of the words stands within `window` characters before."""
    pattern = "|".join(words)
    return lambda m, text: S.before(text, m["start"], window).rlike(pattern)


def both(*checks: Check) -> Check:
    def check(m: Column, text: Column) -> Column:
        out = checks[0](m, text)
        for c in checks[1:]:
            out = out & c(m, text)
        return out

    return check


# Keywords, codes and names that identifiers come with.
LICENSE_WORDS = ("운전면허", "면허번호", "면허증")
FAX_WORDS = ("팩스", "FAX", "fax", "Fax")
PRESCRIPTION_WORDS = ("처방번호", "처방전번호", "처방전 번호", "처방전 발행번호", "처방전교부번호", "교부번호", "Rx")
INSTITUTION_WORDS = ("의료기관기호", "기관기호", "요양기관기호", "요양기관번호", "병원코드")
DRUG_WORDS = ("EDI", "edi", "약품코드", "의약품코드", "주성분코드", "KD코드", "KD 코드", "약가코드")
STAFF_WORDS = ("사번", "공무원번호", "직원번호", "임용번호", "사원번호")
BIRTH_WORDS = ("생년월일", "생일", "출생", "탄생", "태어난", "태어났", "태어나", "DOB", "Date of Birth", "Birth Date", "birthday")
NO_BIRTH_WORDS = (
    "선고일", "심사일", "처리일", "회의일", "시행일", "공포일", "배포일", "발령일", "접수일", "회신일", "통보일", "처분일", "발급일",
    "유효기간", "평가기간", "계약기간", "감사기간", "출동일자", "종결일자", "작성일자", "발생일", "발효일", "효력 발생일", "결재일",
    "회계기간", "회계연도", "기준일", "사용기한", "유통기한", "제조일", "제조연월일", "소비기한", "유효일", "포장일", "출고일",
)
PARCEL_PROVINCES = "11|2[1-69]|3[1-9]|4[1-8]|50"
POSTAL_PREFIXES = "0[1-8]|1[0-8]|2[1-9]|[345][0-9]|6[123]"
VEHICLE_LETTERS = "가나다라마거너더러머버서어저고노도로모보소오조구누두루무부수우주바사아자배하허호외영준협대국합육해공"
VEHICLE_UNITS = "원|달러|엔|위안|유로|파운드|프랑|억|만|천|백|조|%|퍼센트|포인트|포|건|명|년|월|일|시간|분|초|톤|kg|g|m|km"
CASE_CODES = (
    "가합 가단 가소 카합 카단 카기 고합 고단 고정 형보 고약 고전 구합 구단 구약 드합 드단 수단 수합 후단 후합 헌가 헌나 헌다 헌라 헌마 헌바"
    " 나 다 차 머 노 도 초 누 두 르 므 호 자 보 사 허 라 마 바"
).split()
BANKS = (
    "국민은행 신한은행 우리은행 하나은행 기업은행 IBK KEB하나은행 KEB KB국민은행 KB 농협은행 농협 NH농협 NH 수협은행 수협 Sh수협 SC제일은행 제일은행 씨티은행"
    " 한국씨티 외환은행 스탠다드차타드 카카오뱅크 카뱅 카카오페이 토스뱅크 토스뱅킹 토스페이 케이뱅크 K뱅크 네이버페이 부산은행 BNK부산 대구은행 DGB대구 경남은행"
    " BNK경남 광주은행 전북은행 제주은행 JB제주 산업은행 KDB산업 수출입은행 EXIM 한국은행 BOK 우체국 우정사업본부 우정청 새마을금고 MG새마을 MG 신협 신용협동조합"
    " 수산업협동조합 농업협동조합 국민 신한 우리 하나"
).split()
VERSION_BEFORE = r"(?:버전|버젼|펌웨어|릴리[스즈]|빌드|패치|(?<![A-Za-z\p{IsLatin}\p{M}])(?:[vV]\.?|ver\.?|version|firmware|release|build|patch))\s*$"
SECTION_BEFORE = r"(?:표|그림|별표|도표|붙임|항목|조항|조|항|단계|절|장|챕터|[Ss]ection|[Cc]hapter|[Ff]igure|[Tt]able|[Aa]ppendix|[Cc]lause|(?<![A-Za-z\p{IsLatin}\p{M}])(?:[Ss]ec|[Cc]h|[Ff]ig|[Aa]pp)\.?)\s*$"
VERSION_AFTER = r"^\s*(?:버전|버젼|version|빌드|build|릴리[스즈])"
INFANT_WORDS = ("아기", "아이", "딸", "아들", "둘째", "첫째", "생후", "만 ", "되었", "지났", "돌", "출산")
COUNTRIES = (
    "한국 대한민국 미국 일본 중국 북한 대만 홍콩 몽골 캐나다 멕시코 브라질 아르헨티나 칠레 페루 콜롬비아 쿠바 영국 아일랜드 프랑스 독일 이탈리아 스페인 포르투갈"
    " 네덜란드 벨기에 스위스 오스트리아 스웨덴 노르웨이 핀란드 덴마크 폴란드 체코 헝가리 그리스 러시아 우크라이나 터키 튀르키예 이스라엘 사우디 이란 이집트 남아공"
    " 인도 파키스탄 방글라데시 스리랑카 네팔 태국 베트남 인도네시아 필리핀 말레이시아 싱가포르 미얀마 캄보디아 라오스 호주 뉴질랜드 카자흐스탄 우즈베키스탄"
    " 키르기스스탄 투르크메니스탄 모로코 알제리 튀니지 리비아 수단 에티오피아 케냐 탄자니아 우간다 가나 나이지리아 기니 에콰도르 베네수엘라 우루과이 파라과이 볼리비아"
).split()
PARTICLES = "에게서 한테서 께서 에게 한테 에서 으로 보다 이가 이는 이도 이를 은 는 이 가 을 를 와 과 의 에 도 만 야 라 여".split()
PROVINCES = (
    "서울특별시 부산광역시 대구광역시 인천광역시 광주광역시 대전광역시 울산광역시 세종특별자치시 경기도 강원특별자치도 강원도 충청북도 충청남도"
    " 전북특별자치도 전라북도 전라남도 경상북도 경상남도 제주특별자치도 제주도"
).split()
BUILDINGS = "빌딩 타워 센터 스퀘어 플라자 오피스텔 아파트 맨션 하이츠 캐슬 팰리스 레지던스 빌라 주공 자이 래미안 푸르지오 더샵 아이파크 힐스테이트".split()
MAJOR_PARTS = (
    "컴퓨터 소프트웨어 정보 통신 전자 전기 기계 자동차 항공 우주 조선 해양 건축 토목 도시 환경 화학 화공 생명 생물 물리 수 통계 천문 지구 지질 재료 신소재 산업 에너지 원자력"
    " 식품 영양 의류 의상 아동 가정 소비자 경영 경제 회계 무역 금융 국제 통상 행정 정치 외교 사회 복지 심리 교육 법 언론 신문 방송 광고 홍보 문헌 인류 철 사 종교 신"
    " 국어 국문 영어 영문 독어 독문 불어 불문 중어 중문 일어 일문 노어 노문 서어 서문 한문 언어 미술 회화 조소 디자인 음악 작곡 성악 무용 연극 영화 체육 간호 약 의 치의 한의 수의"
    " 의예 치의예 한의예 보건 물리치료 임상병리 방사선 농 원예 산림 축산 관광 호텔 공 과 문화 데이터 인공지능 보안 경찰 소방"
).split()
FACULTIES = "의과대학 한의대 수의대 의대 치대 약대 법대 행정대 경상대학 경상대 공대 미대 음대 체대 예대 사범대 신학대 농대 건축대 경영대".split()
TITLES = (
    "대표이사 부사장 사장 부회장 회장 전무 상무 이사 본부장 부장 차장 과장 계장 대리 주임 사원 인턴 팀장 실장 국장 센터장 지점장 점장 그룹장 파트장 소장 원장 총장 학장 처장"
    " 수석연구원 책임연구원 선임연구원 연구원 연구실장 조교수 부교수 교수 강사 조교 박사 교장 교감 교사 선생 의사 전문의 한의사 약사 간호사 변호사 법무사 회계사 세무사 변리사"
    " 노무사 검사장 부장검사 검사 부장판사 판사 대법관 장관 차관 차관보 사무관 서기관 이사관 주무관 주사 서기 시장 군수 구청장 도지사 의원 경정 경감 경위 경사 경장 순경"
    " 소방위 소방장 소방사 대장 중장 소장 준장 대령 중령 소령 대위 중위 소위 상사 중사 하사 병장 대사 영사 목사 신부 수녀 매니저 기사 기장"
).split()
SURNAMES = (
    "김이박최정강조윤장임한오서신권황안송류유전홍고문양손배백허남심노하곽성차주우구민진나지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국"
    "어은편용예경봉사부가복태목형피두감음빈동온호범좌팽승간상시갈단견당"
)
LONG_SURNAMES = "남궁 황보 제갈 사공 선우 서문 독고 동방 어금 망절 무본 황목 등정 장곡 강전 소봉 한양".split()
NAME_FIELDS = (
    "성명 이름 성함 신청인 신청자 민원인 대표자 담당자 작성자 보호자 환자명 환자 고객명 예금주 수령인 수취인 발신인 수신인 신고인 신고자 피의자 피해자 원고 피고 고소인 청구인 피청구인 계약자 세대주"
    " 채무자 채권자 임차인 임대인 매도인 매수인 참석자 담임 학생명 직원명 회원명"
).split()
NO_NAMES = (
    "성명 이름 성함 신청 신청인 신청자 주소 전화 정보 이메일 고객 고객명 연락 연락처 주민 한국 이사 전무 사원 사장 시장 여자 남자 학생 직원 회원 담당 담당자 대리 부장 과장 차장 서울 부산 대구 인천 광주"
    " 대전 경기 강원 제주 전국 국민 시민 주민등록 사업자 신분증 여권 계좌 은행 문의 안내 확인 결과 내용 오늘 내일 우리 모두 이것 저것 그것 이번 지난 다음 현재 기타 없음 미상 해당 동의 신고 원고 피고"
    " 조사 수사 처리 접수 제출 서류 기관 부서 소속 직책 직급 직위 성별 나이 생년 변호사 교수 의사 간호사 판사 검사 강사 조교 목사 기사 기장 장관 의원 원장 소장 국장 팀장 실장 점장 선생 선생님 환자"
).split()
#: Cities and wards that begin like a surname.
NO_PERSON_PLACES = (
    "강남구 강동구 강북구 강서구 노원구 도봉구 마포구 서초구 성동구 성북구 송파구 양천구 용산구 은평구 종로구 구로구 동작구 금천구 관악구 광진구 유성구 남동구 연수구 부평구 계양구"
    " 성남시 안양시 안산시 고양시 용인시 오산시 하남시 이천시 안성시 김포시 양주시 여주시 강릉시 원주시 제천시 공주시 서산시 전주시 정읍시 남원시 김제시 여수시 나주시 경주시"
    " 김천시 안동시 문경시 경산시 진주시 김해시 양산시 구리시 구미시 문산읍 서귀포 양평군 강화군"
).split()
SCHOOL_WORDS = ("졸업", "다녀", "다닌", "출신", "재학", "입학", "퇴학", "전학", "모교", "동문", "동창")
RESIDENT_CENTURIES = {1: 1900, 2: 1900, 3: 2000, 4: 2000, 9: 1800, 0: 1800}
FOREIGN_CENTURIES = {5: 1900, 6: 1900, 7: 2000, 8: 2000}

_SIX_SEVEN = r"[0-9]{6}(?:\s?[-./]\s?|[-./\s]{0,2})[0-9]{7}(?![0-9])"
_GAP = r"[-.\s]{0,2}"
_ABROAD = r"(?<![0-9])(?:\+82|0082|82)[-.\s]?(?:\(0\)[-.\s]?)?"
_ACCOUNT = r"[0-9]+(?:[\s\-][0-9]+){1,4}|[0-9]{10,16}"


def _resident(as_of: str) -> Check:
    today = int(as_of.replace("-", ""))

    def check(m: Column, text: Column) -> Column:
        number = m["number"]
        corporate = (C.digit(number, 7, 13) == 0) & C.corporate_valid(number) & ~C.rrn_valid(number)
        barcode = m["digits"].startswith("880") & (m["text"] == m["digits"]) & ~C.rrn_valid(number)
        return (C.birth_day(number, RESIDENT_CENTURIES) <= today) & ~corporate & ~barcode

    return check


def _corporate(last_day: int) -> Check:
    def check(m: Column, text: Column) -> Column:
        number = m["number"]
        book = m["digits"].rlike("^97[89]") & (m["text"] == m["digits"])
        day = C.day_exists(F.lit(2000), C.places(number, 3, 4, 13), C.places(number, 5, 6, 13)) & (C.places(number, 5, 6, 13) <= last_day)
        return ~book & C.corporate_valid(number) & ~(day & C.rrn_valid(number))

    return check


def _card(m: Column, text: Column) -> Column:
    number = m["digits"]
    shape = number.rlike("^(?:4[0-9]{12}|[234569][0-9]{13}|3[47][0-9]{13}|[234569][0-9]{15,18})$")
    return shape & C.luhn_valid(number)


def _ipv4(m: Column, text: Column) -> Column:
    parts = F.split(m["text"], r"\.")
    a, b, c = (parts[i].try_cast("int") for i in range(3))
    inside = ~F.exists(parts, lambda p: p.try_cast("int") > 255)
    reserved = (
        a.isin(0, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 192) & (b == 0) & (c == 2))
        | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    return inside & ~reserved


def _no_version(m: Column, text: Column) -> Column:
    left = S.before(text, m["start"], 12)
    return ~left.rlike(VERSION_BEFORE) & ~left.rlike(SECTION_BEFORE) & ~S.after(text, m["end"], 8).rlike(VERSION_AFTER)


def _ipv6(m: Column, text: Column) -> Column:
    address = F.split(m["text"], "%")[0]
    short = address.contains("::")
    groups = F.filter(F.split(address, ":"), lambda g: g != "")
    four = address.rlike(r":[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    shaped = F.forall(groups, lambda g: g.rlike(r"^[0-9A-Fa-f]{1,4}$|^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$"))
    width = F.size(groups) + four.cast("int")
    once = ~address.rlike(":::|::.*::|^:[^:]|[^:]:$")
    return (address != "::") & shaped & once & F.when(short, width <= 7).otherwise(width == 8)


def _issued(m: Column, text: Column) -> Column:
    year = F.substring(m["text"], 1, 4).try_cast("int")
    return year.between(1990, 2099) & C.day_exists(year, F.substring(m["text"], 5, 2).try_cast("int"), F.substring(m["text"], 7, 2).try_cast("int"))


def _born(as_of: str, marked: bool) -> Check:
    now = int(as_of[:4])

    def check(m: Column, text: Column) -> Column:
        parts = F.regexp_extract_all(m["text"], F.lit("[0-9]+"), F.lit(0))
        written = parts[0].try_cast("int")
        year = F.when(written < 100, F.when(written <= now % 100, written + 2000).otherwise(written + 1900)).otherwise(written)
        named = S.before(text, m["start"], 25).rlike("|".join(BIRTH_WORDS))
        if marked:
            named = named | S.after(text, m["end"], 2).startswith("생")
        other = S.before(text, m["start"], 15).rlike("|".join(NO_BIRTH_WORDS))
        return year.between(1900, now) & C.day_exists(year, parts[1].try_cast("int"), parts[2].try_cast("int")) & named & ~other

    return check


def _number_between(low: float, high: float) -> Check:
    return lambda m, text: F.regexp_extract(m["text"], r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double").between(low, high)


def _countries() -> str:
    """A country's name, which the particle that a word ends with, and 인 before it, may follow. A name that
    itself ends like a particle loses that when it stands alone, as any word does, and is no name then."""
    ends = lambda c: [p for p in PARTICLES if c.endswith(p)]
    word, stop = "(?<![가-힣A-Za-z0-9])(?=[가-힣]{2,8}(?![가-힣A-Za-z0-9]))", "(?![가-힣A-Za-z0-9])"
    plain = "|".join(c for c in COUNTRIES if not ends(c))
    parts = [rf"(?:{plain})(?=인?(?:{'|'.join(PARTICLES)})?{stop})"]
    for c in (c for c in COUNTRIES if ends(c)):
        after = [p for p in PARTICLES if not any(q.endswith(p) and (c + p).endswith(q) and len(q) > len(p) for q in PARTICLES)]
        parts.append(rf"{c}(?=(?:인(?:{'|'.join(PARTICLES)})?|{'|'.join(after)}){stop})")
    return f"{word}(?:{'|'.join(parts)})"


def _near_school(m: Column, text: Column) -> Column:
    return F.concat(S.before(text, m["start"], 15), F.lit("\n"), S.after(text, m["end"], 15)).rlike("|".join(SCHOOL_WORDS))


_PROVINCE = "|".join(PROVINCES)
_TAIL = (
    rf"(?:\s*[0-9]+[동호층]|\s+[가-힣A-Za-z0-9]{{2,20}}(?=\s+[0-9]+[동호층])|\s+[가-힣A-Za-z0-9]{{0,20}}(?:{'|'.join(BUILDINGS)}))*"
    r"(?:\s*\([가-힣A-Za-z0-9,·\s]+\))?"
)


def _address(place: str) -> str:
    """Province, up to two of city, county and ward, a place with its number, and what stands inside it."""
    return rf"(?<![가-힣A-Za-z0-9])(?:(?:{_PROVINCE})\s*)?(?:[가-힣]{{1,8}}[시군구]\s+){{0,2}}{place}\s*[0-9]+(?:-[0-9]+)?(?![0-9-])(?:\s*번지)?{_TAIL}"


def _placed(m: Column, text: Column) -> Column:
    """A number after a place is an address where a wider place or the word for one stands before it."""
    return m["text"].rlike(rf"^(?:(?:{_PROVINCE})|[가-힣]{{1,8}}[시군구]\s)") | S.before(text, m["start"], 20).contains("주소")


def _name_score(m: Column, text: Column) -> Column:
    """The sum of what speaks for a name: its surname, a field's label or a title beside it, a number or address
    of a person nearby, an age after it. Two characters need more, unless a label or a title stands there."""
    left, right, titles = S.before(text, m["start"], 25), S.after(text, m["end"], 25), "|".join(TITLES)
    label = left.rlike(rf"(?:{'|'.join(NAME_FIELDS)})\s*[:：]?\s*$")
    title = right.rlike(rf"^\s?(?:{titles}|씨|님)(?![가-힣]{{3}})") | left.rlike(rf"(?:{titles})\s$")
    known = F.concat(left, F.lit("\n"), right).rlike(r"[0-9]{6}-?[0-9]{7}|01[01679][-. ]?[0-9]{3,4}[-. ]?[0-9]{4}|[A-Za-z0-9]@[A-Za-z0-9]")
    aged = F.substring(right, 1, 12).rlike(r"^\s*[,(]?\s*(?:만\s*)?(?:[0-9]{1,3}\s*세|[남여](?:성|자)?(?![가-힣]))")
    short = F.length(m["text"]) <= 2
    part = lambda test, points: F.when(test, points).otherwise(0.0)
    total = 0.15 + part(label, 0.5) + part(title, 0.35) + F.when(known, F.when(short, 0.2).otherwise(0.4)).otherwise(0.0) + part(aged, 0.3)
    return F.round(F.least(F.lit(1.0), total - part(short & ~label & ~title, 0.1)), 2)


def _no_common_word(m: Column, text: Column) -> Column:
    return ~m["text"].isin(NO_NAMES + NO_PERSON_PLACES) & ~m["text"].rlike(rf"^(?:{'|'.join(TITLES)})$")


def _account(m: Column, text: Column) -> Column:
    return F.length(m["digits"]).between(10, 16)


def rules(as_of: str = AS_OF, last_day: int = 31) -> list[Rule]:
    """All rules; those of a label stand together, in the order of their passes."""
    resident, foreign = _resident(as_of), lambda m, t: C.birth_day(m["number"], FOREIGN_CENTURIES).isNotNull()
    year = int(as_of[:4])

    def year_only(m: Column, text: Column) -> Column:
        written = F.regexp_extract(m["text"], "[0-9]+", 0).try_cast("int")
        full = F.when(written < 100, F.when(written <= year % 100, written + 2000).otherwise(written + 1900)).otherwise(written)
        return full.between(1900, year)

    sure = lambda m, t: C.rrn_valid(m["number"])
    banks, titles, parts = "|".join(BANKS), "|".join(sorted(set(TITLES), key=lambda t: (-len(t), t))), "|".join(MAJOR_PARTS)
    return [
        Rule("RRN", rf"(?<![0-9]){_SIX_SEVEN}", CRITICAL, 1.0, resident, unsure=0.7, sure=sure),
        Rule("RRN", rf"(?<![0-9])([0-9])({_SIX_SEVEN})", CRITICAL, 1.0, resident, lead=1, value=2, unsure=0.7, sure=sure, exact=True),
        Rule("FRN", rf"(?<![0-9]){_SIX_SEVEN}", CRITICAL, 1.0, foreign, unsure=0.7, sure=sure),
        Rule("BUSINESS_REG", r"(?<![0-9])[0-9]{3}-?[0-9]{2}-?[0-9]{5}(?![0-9])", HIGH, 1.0, lambda m, t: C.business_valid(m["number"])),
        Rule("CORP_REG", rf"(?<![0-9]){_SIX_SEVEN}", MEDIUM, 1.0, _corporate(last_day)),
        Rule("DRIVER_LICENSE", r"(?<![0-9])(?:1[1-9]|2[0-8])-[0-9]{2}-[0-9]{6}-[0-9]{2}(?![0-9])", CRITICAL, 0.85),
        Rule("DRIVER_LICENSE", r"(?<![0-9])(?:1[1-9]|2[0-8])[0-9]{10}(?![0-9])", CRITICAL, 0.85, keyword(LICENSE_WORDS, 15), exact=True),
        Rule("PASSPORT", r"(?<![A-Za-z0-9])(?:P[PMSODRT]|[MSGODRT])(?!0{8})[0-9]{8}(?![A-Za-z0-9])", CRITICAL, 0.9),
        Rule("CARD", r"(?<![0-9])(?:(?:[0-9]{4}[-. /]\s?){3}[0-9]{1,7}|[0-9]{13,19})(?![0-9])", HIGH, 1.0, _card),
        Rule("MEDICAL_INSURANCE", r"(?<![0-9-])(?:[0-9]-[0-9]{10}|[0-9]{11})(?![0-9-])", HIGH, 0.9, keyword((r"건강\s*보험", r"의료\s*보험", "보험증"), 25)),
        Rule("PRESCRIPTION_ID", r"(?<![0-9])[0-9]{12}(?![0-9])", HIGH, 0.9, both(_issued, keyword(PRESCRIPTION_WORDS, 20))),
        Rule("PRESCRIPTION_ID", r"(?<![A-Za-z0-9])[A-Za-z]{2,6}-[0-9][0-9A-Za-z-]{3,22}(?![A-Za-z0-9])", HIGH, 0.88, keyword(PRESCRIPTION_WORDS, 18), gate="digit"),
        Rule("PRESCRIPTION_ID", r"(?<![0-9])[0-9]{8}(?![0-9])", MEDIUM, 0.85, keyword(INSTITUTION_WORDS, 15)),
        Rule("PNU", rf"(?<![0-9])(?:{PARCEL_PROVINCES})[0-9]{{8}}[1-9](?!0000)[0-9]{{8}}(?![0-9])", LOW, 0.9),
        Rule("FAX", r"(?<![0-9+])0[0-9]{1,2}[-.\s]?[0-9]{3,4}[-.\s]?[0-9]{4}(?![0-9])", LOW, 0.85, keyword(FAX_WORDS, 12)),
        Rule("PHONE", rf"{_ABROAD}1[01679]{_GAP}[0-9]{{3,4}}{_GAP}[0-9]{{4}}(?![0-9])", HIGH, 1.0),
        Rule("PHONE", rf"{_ABROAD}2{_GAP}[0-9]{{3,4}}{_GAP}[0-9]{{4}}(?![0-9])", MEDIUM, 1.0),
        Rule("PHONE", rf"{_ABROAD}(?:3[1-3]|4[1-4]|5[1-5]|6[1-4]|70){_GAP}[0-9]{{3,4}}{_GAP}[0-9]{{4}}(?![0-9])", MEDIUM, 1.0),
        Rule("PHONE", rf"(?<![0-9+])01[01679]{_GAP}[0-9]{{3,4}}{_GAP}[0-9]{{4}}(?![0-9])", HIGH, 1.0),
        Rule("PHONE", rf"(?<![0-9+])(?:03[1-3]|04[1-4]|05[1-5]|06[1-4]|070)[-.\s)\]]{{0,2}}[0-9]{{3,4}}{_GAP}[0-9]{{4}}(?![0-9])", MEDIUM, 1.0),
        Rule("PHONE", rf"(?<![0-9+])02[-.\s)\]]{{0,2}}[0-9]{{3,4}}{_GAP}[0-9]{{4}}(?![0-9])", MEDIUM, 1.0),
        Rule("PHONE", rf"(?<![0-9+])1[5-8][0-9]{{2}}{_GAP}[0-9]{{4}}(?![0-9])", MEDIUM, 1.0),
        Rule(
            "EMAIL",
            r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+(?![A-Za-z0-9])",
            MEDIUM, 1.0, lambda m, t: ~m["text"].rlike(r"^\.|\.@|\.\."), gate="at",
        ),
        Rule("POSTAL_CODE", rf"(우편\s*번호\s*:?\s*|우편\s*:?\s*)((?:{POSTAL_PREFIXES})[0-9]{{3}})(?![0-9])", LOW, 1.0, lead=1, value=2, gate="hangul four"),
        Rule("POSTAL_CODE", r"(?<![0-9])[1-7][0-9]{2}-[0-9]{3}(?![0-9])", LOW, 0.85, exact=True, gate="digit"),
        Rule("IP", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])", MEDIUM, 1.0, _ipv4, gate="digit", context=_no_version),
        Rule(
            "IP",
            r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f:]*::[0-9A-Fa-f:]*(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3})?|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?:%[A-Za-z0-9]+)?(?![0-9A-Fa-f:.])",
            MEDIUM, 1.0, _ipv6, exact=True, gate="colon",
        ),
        Rule(
            "VEHICLE", rf"(?<![0-9가-힣])[0-9]{{2,3}}\s?[{VEHICLE_LETTERS}]\s?(?!0000)[0-9]{{4}}(?![0-9])", LOW, 0.85,
            lambda m, t: ~S.after(t, m["end"], 8).rlike(rf"^\s*(?:{VEHICLE_UNITS})"), gate="hangul four",
        ),
        Rule("URL", r"(?i)\bhttps?://[^\s<>\"'`)\]}]+", INFO, 0.9, trim=r"[.,;:!?]+$", gate="colon"),
        Rule("ADDRESS", _address("[가-힣A-Za-z0-9]{1,16}(?:로|길)"), MEDIUM, 0.8, _placed, gate="hangul digit"),
        Rule("ADDRESS", _address("[가-힣]{1,8}[동읍면리]"), MEDIUM, 0.75, _placed, gate="hangul digit"),
        Rule("NATIONALITY", _countries(), LOW, 0.7, gate="hangul"),
        Rule("EDUCATION", "(?<![가-힣A-Za-z])(?:KAIST|POSTECH|UNIST|D?GIST|카이스트|포스텍|유니스트|지스트|디지스트)(?![가-힣A-Za-z])", MEDIUM, 0.95, gate="school"),
        Rule("EDUCATION", "(?<![가-힣A-Za-z])[가-힣]{2,10}(?:초등|중|고등)학교(?![가-힣A-Za-z])", MEDIUM, 0.85, gate="hangul"),
        Rule("EDUCATION", "(?<![가-힣A-Za-z])[가-힣]{2,8}[초중고](?![가-힣A-Za-z])", MEDIUM, 0.85, _near_school, gate="hangul"),
        Rule("ACCOUNT", r"(계좌\s*(?:번호|번)?\s*:?\s*)([0-9](?:[\s\-]*[0-9]){9,19})", HIGH, 0.9, _account, lead=1, value=2, gate="hangul digit"),
        Rule("ACCOUNT", rf"((?:{banks})\s*:?\s*)({_ACCOUNT})", HIGH, 0.9, _account, lead=1, value=2, gate="bank digit"),
        Rule("ACCOUNT", rf"(?<![0-9])({_ACCOUNT})(?:\s*(?:{banks}))", HIGH, 0.9, _account, value=1, gate="bank digit"),
        Rule(
            "PERSON",
            rf"(?<![가-힣])(?:(?:{'|'.join(LONG_SURNAMES)})[가-힣]{{1,2}}|[{SURNAMES}][가-힣]{{1,2}})(?=(?:씨|님|{titles})?(?:{'|'.join(PARTICLES)})?(?![가-힣]))",
            HIGH, 0.5, _no_common_word, score=_name_score, gate="hangul",
        ),
        Rule("EDI_DRUG", r"(?<![0-9])88[018][0-9]{10}(?![0-9])", LOW, 0.9, keyword(DRUG_WORDS, 18)),
        Rule("EDI_DRUG", r"(?<![0-9])[0-9]{9}(?![0-9])", LOW, 0.85, keyword(DRUG_WORDS, 18)),
        Rule("COURT_CASE", rf"(?<![0-9가-힣])(?:19|20)[0-9]{{2}}(?:{'|'.join(CASE_CODES)})(?!0+(?![0-9]))[0-9]{{1,6}}(?![0-9가-힣])", MEDIUM, 0.9, gate="hangul four"),
        Rule("DT_BIRTH", r"(?<![0-9])(?:[0-9]{4}|[0-9]{2})\s*년\s*[0-9]{1,2}\s*월\s*[0-9]{1,2}\s*일", HIGH, 0.95, _born(as_of, True), gate="hangul digit"),
        Rule("DT_BIRTH", r"(?<![0-9])[0-9]{2,4}(?:\.[0-9]{1,2}\.|/[0-9]{1,2}/|-[0-9]{1,2}-)[0-9]{1,2}(?![0-9])", HIGH, 0.9, _born(as_of, False), gate="digit"),
        Rule("DT_BIRTH", r"(?<![0-9])[0-9]{2,4}\s*년\s*생", MEDIUM, 0.85, year_only, gate="hangul digit"),
        Rule("MAJOR", rf"(?<![가-힣A-Za-z])(?:{parts}){{1,4}}(?:학과|학부|전공)", LOW, 0.9, gate="hangul"),
        Rule("MAJOR", rf"(?<![가-힣A-Za-z])(?:{parts}){{1,3}}(?:학|과)(?![가-힣A-Za-z])", LOW, 0.85, lambda m, t: ~m["text"].isin("사과", "의과", "공과", "사학과", "수과"), gate="hangul"),
        Rule("MAJOR", rf"(?<![가-힣A-Za-z])(?:{'|'.join(FACULTIES)})(?![가-힣A-Za-z])", LOW, 0.8, gate="hangul"),
        Rule("POSITION", rf"(?<![가-힣A-Za-z])(?:{titles})(?![가-힣A-Za-z])", LOW, 0.85, keyword(("직급", "직책", "직위", "보직", "직군"), 12), gate="hangul"),
        Rule("POSITION", rf"(?<![가-힣A-Za-z])(?:{titles})(?=님)", LOW, 0.8, gate="hangul"),
        Rule("AGE", r"(?<![0-9])[0-9]{1,3}\s*[세살](?![0-9])", INFO, 0.95, _number_between(0, 150), gate="hangul digit"),
        Rule("AGE", r"(?<![0-9])[1-9]0대(?![0-9가-힣])", INFO, 0.85, gate="hangul digit"),
        Rule(
            "AGE",
            r"(?<![가-힣])(?:스무|(?:열|스물|서른|마흔|쉰|예순|일흔|여든|아흔)(?:\s*(?:한|두|세|네|다섯|여섯|일곱|여덟|아홉))?|한|두|세|네|다섯|여섯|일곱|여덟|아홉)\s*살",
            INFO, 0.85, gate="hangul",
        ),
        Rule("AGE", r"(?<![가-힣])(?:환갑|회갑|진갑|고희연|고희|칠순|산수|팔순|구순|졸수|백수|백세)(?![가-힣])", INFO, 0.9, gate="hangul"),
        Rule(
            "AGE", r"(?<![0-9])[0-9]{1,2}\s*개월(?![0-9])", INFO, 0.85,
            both(_number_between(0, 60), lambda m, t: F.concat(S.before(t, m["start"], 25), S.after(t, m["end"], 10)).rlike("|".join(INFANT_WORDS))), gate="hangul digit",
        ),
        Rule("HEIGHT", r"(?i)(?<![0-9.])[0-9]{2,3}(?:\.[0-9]{1,2})?\s*(?:cm|센티(?:미터)?|㎝)(?![A-Za-z])", INFO, 0.9, _number_between(50, 250), gate="digit"),
        Rule("HEIGHT", r"(?<![0-9.])1\.[0-9]{1,2}\s*m(?![A-Za-z])", INFO, 0.85, exact=True, gate="digit"),
        Rule("WEIGHT", r"(?i)(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,2})?\s*(?:kg|키로(?:그램)?|킬로(?:그램)?|㎏|kilogram)(?![A-Za-z])", INFO, 0.9, _number_between(1, 300), gate="digit"),
        Rule("DOC_ID", r"(?<![A-Za-z0-9가-힣])[가-힣]{2,6}-[가-힣A-Za-z0-9]{2,10}-(?:19|20)[0-9]{2}-[0-9]{4,6}(?![A-Za-z0-9가-힣])", LOW, 0.85, gate="hangul four"),
        Rule(
            "PETITION_ID",
            r"(?<![A-Za-z0-9가-힣])(?:(?:19|20)[0-9]{2}-(?:민원|정보공개|이의신청|행정심판)|(?:민원|정보공개|이의신청|행정심판)-(?:19|20)[0-9]{2})-[0-9]{4,8}(?![A-Za-z0-9가-힣])",
            LOW, 0.9, gate="hangul four",
        ),
        Rule("EMPLOYEE_ID", r"(?<![0-9])[0-9]{4,12}(?![0-9])", MEDIUM, 0.85, lambda m, t: S.before(t, m["start"], 20).rlike(rf"(?:{'|'.join(STAFF_WORDS)})\s*[:：]?\s*$"), gate="hangul four"),
    ]


#: Labels whose checks read `digits`, a match's digits, and `number`, these as one number; worked out once for a match.
NUMERIC = ("RRN", "FRN", "BUSINESS_REG", "CORP_REG", "CARD", "ACCOUNT")
LABELS = tuple(dict.fromkeys(r.label for r in rules()))


def _of_rule(rule: Rule, rank: int, column: str, names: Syllables | None = None, by_form: bool = False) -> Column:
    text = F.col(column)
    found = S.find_all(column, rule.pattern, rule.lead, rule.value, rule.label, rule.risk, rule.confidence, rank)
    if rule.trim:
        short = lambda m: F.regexp_replace(m["text"], rule.trim, "")
        found = F.transform(found, lambda m: m.withField("end", m["start"] + F.length(short(m))).withField("text", short(m)))
    numeric = rule.label in NUMERIC
    if numeric:
        found = F.transform(F.transform(found, lambda m: m.withField("digits", C.digits(m["text"]))), lambda m: m.withField("number", m["digits"].try_cast("long")))
    if rule.keep:
        found = F.filter(found, lambda m: rule.keep(m, text))
    if rule.context and not by_form:
        found = F.filter(found, lambda m: rule.context(m, text))
    if rule.score:
        more = lambda m: names.bonus(m["text"]) if names else F.lit(0.0)
        found = F.transform(found, lambda m: m.withField("confidence", F.least(F.lit(1.0), rule.score(m, text) + more(m))))
    if rule.sure:
        found = F.transform(found, lambda m: m.withField("confidence", F.when(rule.sure(m, text), rule.confidence).otherwise(rule.unsure)))
    return F.transform(found, lambda m: m.dropFields("digits", "number")) if numeric else found


def label_spans(label: str, column: str, as_of: str = AS_OF, gates: dict[str, Column] | None = None, names: Syllables | None = None, terms: Terms | None = None, by_form: bool = False, last_day: int = 31) -> Column:
    """Spans of one label in a column, over all its passes; of names, candidates with the score of what stands around them, to which
    a syllable model adds. The terms of a dictionary are a last pass. `by_form` leaves out the rules' tests of the words around."""
    passes = [(i, r) for i, r in enumerate(rules(as_of, last_day)) if r.label == label]
    if terms and terms.terms:
        passes.append((TERM_RANK, Rule(label, terms.pattern, passes[0][1].risk, 0.95, gate="any")))
    parts = []
    for i, r in passes:
        open_ = F.lit(True)
        for name in r.gate.split():
            open_ = open_ & (gates[name] if gates else GATES[name](F.col(column)))
        parts.append(F.when(open_, _of_rule(r, i, column, names, by_form)).otherwise(F.expr(S.NO_SPANS)))
    if len(parts) == 1:
        return parts[0]
    # Spans of labels whose rules have a score are candidates: `accumulated` tells which of them are names.
    exact = [i for i, r in passes if r.exact]

    def clash(kept: Column, x: Column) -> Column:
        same = (kept["start"] == x["start"]) & (kept["end"] == x["end"])
        return (kept["rank"] != x["rank"]) & F.when(x["rank"].isin(exact), same).otherwise(S.overlaps(kept, x)) if exact else (kept["rank"] != x["rank"]) & S.overlaps(kept, x)

    return S.first_come(F.concat(*parts), clash)


def detect(df: DataFrame, text: str = "text", name: str = "spans", include: list[str] | None = None, exclude: list[str] | None = None, as_of: str = AS_OF, names: Syllables | None = None, dictionaries: dict[str, Terms] | None = None, by_form: tuple[str, ...] = (), last_day: int = 31) -> DataFrame:
    """df with an array of resolved spans. Labels are chosen before overlaps are resolved, so leaving one
    out can bring up what it covered. `dictionaries` gives labels terms of their own, matched after their rules. Labels in
    `by_form` are taken by their form, whatever words stand around: addresses of machines then aren't held for versions or numbers of
    sections, whose words are ordinary ones in other languages. A corporation's number that is a resident's too is none of CORP_REG, if its day of
    birth is `last_day` at most: the calendar's by default. Null text has no spans; a column with the name is replaced."""
    chosen = [x for x in LABELS if (not include or x in include) and x not in (exclude or ())]
    gates = {f"_gate_{n}": test(F.col(text)) for n, test in GATES.items()}
    opened = {n: F.col(f"_gate_{n}") for n in GATES}
    columns = {f"_{x}": F.coalesce(label_spans(x, text, as_of, opened, names, (dictionaries or {}).get(x), x in by_form, last_day), F.expr(S.NO_SPANS)) for x in chosen}
    found = df.withColumns(gates).withColumns(columns)
    # Columns of their own, since the analyzer takes a round for each level of lambdas.
    scored = {f"_{r.label}" for r in rules(as_of) if r.score and r.label in chosen}
    found = found.withColumns({c: accumulated(F.col(c), F.col(text)) for c in scored})
    every = F.concat(*columns) if columns else F.expr(S.NO_SPANS)
    resolved = F.when(F.size(every) > 0, S.resolve(every)).otherwise(F.expr(S.NO_SPANS))
    return found.withColumn(name, resolved).drop(*columns, *gates)
