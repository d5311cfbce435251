import duckdb
import pytest
from pyspark.sql import functions as F

from garim.functions import spans as S
from garim.functions.labels import POLICIES, action
from garim.functions.normalize import detect_normalized, with_normalized
from garim.operators import analytics, masking, merge
from garim.operators.detectors import LABELS, detect
from garim.plans import catalog

CASES = [
    ("주민번호 900101-1234568 입니다", {"RRN": "900101-1234568"}),
    ("외국인 900101-5234567", {"FRN": "900101-5234567"}),
    ("사업자 123-45-67891", {"BUSINESS_REG": "123-45-67891"}),
    ("면허 11-22-123456-78", {"DRIVER_LICENSE": "11-22-123456-78"}),
    ("면허 99-22-123456-78", {}),
    ("여권 M12345678", {"PASSPORT": "M12345678"}),
    ("여권 M00000000", {}),
    ("카드 4111-1111-1111-1111", {"CARD": "4111-1111-1111-1111"}),
    ("카드 4111-1111-1111-1112", {}),
    ("연락처 +82-10-1234-5678", {"PHONE": "+82-10-1234-5678"}),
    ("US +1 (663) 555-6869", {}),
    ("fax 팩스 031-123-4567", {"PHONE": "031-123-4567"}),
    ("a.b@example.com", {"EMAIL": "a.b@example.com"}),
    (".a@example.com a..b@example.com", {}),
    ("서버 8.8.8.8", {"IP": "8.8.8.8"}),
    ("버전 1.2.3.4 127.0.0.1 999.1.1.1", {}),
    ("주소 2001:db8::1", {"IP": "2001:db8::1"}),
    ("12가3456", {"VEHICLE": "12가3456"}),
    ("20명5000 10만5000원 12가0000", {}),
    ("see http://a.b/c).", {"URL": "http://a.b/c"}),
    ("국민은행 110-123-456789", {"ACCOUNT": "110-123-456789"}),
    ("2023가단12345", {"COURT_CASE": "2023가단12345"}),
    ("생년월일 1990.01.02", {"DT_BIRTH": "1990.01.02"}),
    ("처리일 생년월일 1990.01.02", {}),
    ("스물 다섯 살", {"AGE": "스물 다섯 살"}),
    ("키 175cm, 70kg", {"HEIGHT": "175cm", "WEIGHT": "70kg"}),
    ("사번: 12345", {"EMPLOYEE_ID": "12345"}),
    ("미국인이 왔다", {"NATIONALITY": "미국"}),
    ("인도 여행, 한국어, 중국산", {}),
    ("인도는 크다", {"NATIONALITY": "인도"}),
    ("서울고 출신", {"EDUCATION": "서울고"}),
    ("서울고 앞", {}),
    ("한빛초등학교", {"EDUCATION": "한빛초등학교"}),
    ("KAIST 재학", {"EDUCATION": "KAIST"}),
    ("민원-2023-12345", {"PETITION_ID": "민원-2023-12345"}),
    ("서울특별시 강남구 테헤란로 152 한빛타워 12층 (역삼동) 앞", {"ADDRESS": "서울특별시 강남구 테헤란로 152 한빛타워 12층 (역삼동)"}),
    ("주소: 역삼동 12-3번지", {"ADDRESS": "역삼동 12-3번지"}),
    ("세종로 1 근처, 강남구 구호 1", {}),
    ("성명: 홍길동, 홍길동은 갔다", {"PERSON": "홍길동"}),
    ("김철수 (32세)가 왔다 나박김치", {"AGE": "32세"}),
    ("남궁민수 과장이 왔다", {"PERSON": "남궁민수"}),
    ("강남구 과장, 성남시 시장", {}),
    ("이메일 주소 안내, 이순신은 장군", {}),
    ("컴퓨터공학과 졸업, 물리학 강의", {"MAJOR": "물리학"}),
    ("사과 학과 한과", {}),
    ("직책: 책임연구원", {"POSITION": "책임연구원"}),
    ("부장님께 부장이", {"POSITION": "부장"}),
    ("", {}),
    (None, {}),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(CASES)], "doc_id int, text string, spans string")
    return {r.doc_id: r.spans for r in detect(df).collect()}


def test_cases(found):
    for i, (text, expected) in enumerate(CASES):
        assert {s.label: s.text for s in found[i]} == expected, text
        for s in found[i]:
            assert text[s.start : s.end] == s.text


def test_choice_comes_before_overlap(spark):
    df = spark.createDataFrame([("팩스 031-123-4567",)], "text string")
    assert [s.label for s in detect(df).first().spans] == ["PHONE"]
    assert [s.label for s in detect(df, exclude=["PHONE"]).first().spans] == ["FAX"]
    assert len(LABELS) == 33


def test_resolution_prefers_risk_then_confidence_then_length(spark):
    rows = [("A", 0, 10, 3, 1.0), ("B", 4, 18, 5, 0.7), ("C", 18, 20, 2, 0.5), ("D", 18, 20, 2, 0.9), ("E", 20, 22, 2, 0.5), ("F", 20, 25, 2, 0.5)]
    spans = [(label, "", a, z, r, c, i) for i, (label, a, z, r, c) in enumerate(rows)]
    df = spark.createDataFrame([(spans,)], f"s array<{S.SPAN}>")
    assert [s.label for s in df.select(S.resolve(F.col("s")).alias("s")).first().s] == ["B", "D", "F"]


def test_masks(spark):
    values = {
        ("RRN", "900101-1234567"): "900101-1******", ("PHONE", "010-1234-5678"): "010-****-5678", ("PHONE", "02.123.4567"): "02.***.4567",
        ("PHONE", "+82-10-1234-5678"): "+82-10-****-5678", ("EMAIL", "ab@x.com"): "a***@x.com", ("CARD", "4111-1111-1111-1111"): "4111-****-****-1111",
        ("CARD", "4111111111111111"): "4111********1111", ("PASSPORT", "M12345678"): "M******78", ("ACCOUNT", "110-123-456789"): "1101****6789",
        ("DT_BIRTH", "1990.1.2"): "1990.**.**", ("DT_BIRTH", "1990년 1월 2일"): "1990년 **월 **일", ("AGE", "37세"): "30대", ("AGE", "7살"): "10대 미만",
        ("HEIGHT", "1.75m"): "175-180cm", ("WEIGHT", "72kg"): "70-75kg", ("EDUCATION", "서울대학교"): "○대학교", ("MAJOR", "물리학과"): "○○학과",
        ("PERSON", "홍길동"): "홍OO", ("PERSON", "남궁민수"): "남궁OO", ("OTHER", "abcdef"): "ab**ef", ("OTHER", "abcd"): "****",
    }
    df = spark.createDataFrame([(*k, v) for k, v in values.items()], "label string, value string, expected string")
    bad = df.withColumn("got", masking.partial_mask(F.col("label"), F.col("value"))).where("got <> expected").collect()
    assert not bad


def test_policy_and_combined_risk(spark):
    df = spark.createDataFrame([(2, 0.95, "STRICT"), (5, 0.7, "PERMISSIVE"), (5, 1.0, "AUDIT"), (4, 0.8, "BALANCED")], "risk int, conf double, mode string")
    got = [df.where(F.col("mode") == m).select(action(F.col("risk"), F.col("conf"), m).alias("a")).first().a for m in ("STRICT", "PERMISSIVE", "AUDIT", "BALANCED")]
    assert got == ["REVIEW", "REVIEW", "ALLOW", "BLOCK"] and len(POLICIES) == 5
    cases = [(["RRN"], 5), (["PERSON"], 2), (["PERSON", "PHONE"], 3), (["PERSON", "PHONE", "EMAIL", "ADDRESS"], 4), (["PERSON", "PHONE", "MEDICAL_INSURANCE"], 4), ([], 1), (["PERSON", "PERSON"], 2)]
    df = spark.createDataFrame(cases, "labels array<string>, risk int")
    assert all(r.got == r.risk for r in df.withColumn("got", analytics.combined_risk(F.col("labels"))).collect())


def test_unknown_names_are_refused(spark):
    df = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(ValueError):
        masking.mask_text(detect(df), "nothing")
    with pytest.raises(ValueError):
        action(F.lit(1), F.lit(1.0), "nothing")
    with pytest.raises(ValueError):
        merge.merged(F.lit(1), F.lit(1), "nothing")


def test_fallback_asks_the_second_detector_about_what_is_in_review(spark):
    """Of spans in review: agreed, found to be something else, and unknown to it. Settled ones and other places are not its own."""
    row = "array<struct<label:string,text:string,start:int,end:int,risk_level:int,confidence:double,rank:int>>"
    span = lambda label, start, end, risk, conf: (label, "x" * (end - start), start, end, risk, conf, 0)
    first = [span("A", 0, 5, 3, 0.8), span("B", 10, 15, 3, 0.8), span("C", 20, 25, 3, 0.8), span("D", 30, 35, 5, 0.9), span("E", 40, 45, 1, 0.9)]
    second = [span("A", 2, 6, 3, 0.9), span("X", 12, 18, 4, 0.9), span("Y", 23, 33, 5, 1.0), span("Z", 41, 44, 5, 1.0), span("W", 50, 55, 5, 1.0)]
    df = spark.createDataFrame([(first, second), (first, []), ([], second), (None, second)], f"a {row}, b {row}")
    found = df.select(merge.merged(F.col("a"), F.col("b"), "fallback_secondary", policy="BALANCED").alias("s")).collect()
    kept = [("C", 20, 0.8), ("D", 30, 0.9), ("E", 40, 0.9)]
    assert [(x.label, x.start, round(x.confidence, 4)) for x in found[0].s] == [("A", 0, 0.85), ("X", 12, 0.9), *kept]
    assert [(x.label, x.start, x.confidence) for x in found[1].s] == [("A", 0, 0.8), ("B", 10, 0.8), *kept]
    assert not found[2].s and not found[3].s
    strict = df.limit(1).select(merge.merged(F.col("a"), F.col("b"), "fallback_secondary").alias("s")).first().s
    assert [x.label for x in strict] == ["A", "B", "C", "D", "E"]


def test_fallback_query_gives_the_rows_of_its_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(catalog.oracle_sql()["merge_fallback_secondary"]).fetchall()
    found = catalog.queries()["merge_fallback_secondary"](spark, "/root/testdata/sf0.001").select("label", "n", "confidence", "confirmed").collect()
    assert sorted(map(tuple, found)) == sorted(want) and {r.label: r.confirmed == r.n for r in found} == {"EMAIL": True, "IP": False}


def test_normalization(spark):
    plain = with_normalized(spark.createDataFrame([("０１０‐１２３４",), ("a​b",)], "text string")).select("normal.text").collect()
    assert [r.text for r in plain] == ["010-1234", "ab"]
    text = "연락처 ０１０–12​34-５６78 끝"
    df = spark.createDataFrame([(text,), ("phone 010-1234-5678",), (None,), ("",)], "text string")
    rows = [r.spans for r in detect_normalized(df, include=["PHONE"]).collect()]
    assert rows[0][0].text == "０１０–12​34-５６78" and text[rows[0][0].start : rows[0][0].end] == rows[0][0].text
    assert rows[1][0].text == "010-1234-5678" and rows[2] == [] and rows[3] == []


def test_prescription_without_four_digits_in_a_row(spark):
    found = detect(spark.createDataFrame([("처방번호 AB-1A2-3C4",)], "text string"), include=["PRESCRIPTION_ID"]).first()
    assert [x.text for x in found.spans] == ["AB-1A2-3C4"]


def test_words_that_end_like_a_sections_are_none(spark):
    """An address behind a word of another language; by form, behind any word."""
    df = spark.createDataFrame([("équeèch 22.128.123.146",), ("zu ver 42.244.84.203",), ("Ch 1.2.3.4",)], "text string")
    addresses = lambda **how: [[s.text for s in r.spans] for r in detect(df, include=["IP"], **how).collect()]
    assert addresses() == [["22.128.123.146"], [], []]
    assert addresses(by_form=("IP",)) == [["22.128.123.146"], ["42.244.84.203"], ["1.2.3.4"]]


def test_corporate_numbers_that_are_residents_too(spark):
    """A number whose both check digits hold, of a 31st: no corporation's by the calendar, one where days end at the 28th."""
    df = spark.createDataFrame([("법인 110731-0426098 입니다.",), ("법인 130111-0006246 입니다.",)], "text string")
    found = lambda **how: [len(r.spans) for r in detect(df, include=["CORP_REG"], **how).collect()]
    assert found() == [0, 1] and found(last_day=28) == [1, 1]
