"""Names of persons: particles, scripts, romanisation, origin, and which tokens could be one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from garim.operators.detectors import LONG_SURNAMES, PARTICLES, SURNAMES

# Revised Romanisation of initial, vowel and final of a syllable, in Unicode's order.
INITIALS = "g kk n d tt r m b pp s ss - j jj ch k t p h".replace("-", "").split(" ")
VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
FINALS = " k kk ks n nj nh t l lk lm lp ls lt lp lh m p ps t tt ng j ch k t p h".split(" ")


def _readings(pairs: str) -> dict[str, str]:
    return {pair[:-1]: pair[-1] for pair in pairs.split()}


# Standard Korean readings (as in Unihan's kHangul) of characters that are common in names, by reading; a caller
# may give a table of its own.
SURNAME_READINGS = _readings(
    "姜강 高고 孔공 郭곽 具구 權권 吉길 金김 羅나 南남 盧노 都도 馬마 孟맹 明명 文문 閔민 朴박 潘반 方방 裵배 白백 卞변 徐서 石석 薛설 成성 蘇소 孫손 宋송 申신 沈심 安안 梁양"
    " 嚴엄 呂여 延연 廉염 吳오 玉옥 王왕 禹우 元원 魏위 劉유 柳유 尹윤 李이 印인 林임 任임 張장 全전 田전 丁정 鄭정 諸제 曺조 趙조 朱주 池지 陳진 車차 蔡채 千천 崔최 秋추 卓탁 表표"
    " 河하 韓한 咸함 許허 玄현 邢형 洪홍 黃황"
)
LONG_READINGS = {"南宮": "남궁", "皇甫": "황보", "諸葛": "제갈", "司空": "사공", "鮮于": "선우", "獨孤": "독고"}
GIVEN_READINGS = _readings(
    "康강 剛강 建건 健건 謙겸 京경 景경 敬경 慶경 桂계 啓계 光광 廣광 國국 圭규 奎규 根근 槿근 基기 起기 琪기 吉길 娜나 男남 多다 丹단 達달 大대 德덕 道도 度도 東동 童동 棟동 斗두"
    " 蘭란 來래 利리 理리 里리 麟린 萬만 明명 模모 武무 美미 民민 敏민 旻민 範범 炳병 秉병 寶보 福복 鳳봉 彬빈 相상 尙상 祥상 瑞서 錫석 碩석 善선 宣선 仙선 燮섭 聖성 誠성 星성"
    " 世세 素소 秀수 洙수 守수 壽수 淑숙 順순 純순 承승 勝승 時시 植식 信신 雅아 兒아 愛애 姸연 烈열 英영 榮영 永영 泳영 禮예 藝예 玉옥 完완 龍용 容용 鎔용 宇우 佑우 雨우 旭욱"
    " 雲운 雄웅 源원 裕유 潤윤 恩은 銀은 義의 仁인 寅인 日일 一일 子자 在재 載재 才재 貞정 正정 廷정 鍾종 宗종 周주 珠주 俊준 峻준 重중 中중 志지 智지 芝지 鎭진 珍진 眞진 昌창"
    " 哲철 喆철 春춘 忠충 泰태 太태 澤택 弼필 夏하 學학 漢한 海해 赫혁 賢현 鉉현 炫현 亨형 惠혜 慧혜 浩호 鎬호 虎호 弘홍 花화 煥환 孝효 勳훈 輝휘 姬희 熙희 喜희"
)
# Syllables that no Korean name begins with, and those of foreign names.
FOREIGN_FIRST = "라랴러려로료루류르리냐녀뇨뉴니"
FOREIGN_SYLLABLES = "쉬츠체테토트프푸퍼팻쳇케캐쿠쿵콩콘베뱀뷔마메모무므샤쇼슈솨샹스"
ADMIN_SUFFIXES = "시도구군동면리읍촌관원장청부과사법안비주회당단조임수료금급"


def without_particle(token: Column) -> Column:
    """A token without the particle that it ends with: of those that fit, the first in the list's order; the token
    itself if none does or nothing would be left."""
    out = token
    for particle in reversed(PARTICLES):
        out = F.when(token.endswith(particle) & (F.length(token) > len(particle)), F.substring(token, F.lit(1), F.length(token) - len(particle))).otherwise(out)
    return out


def has_hanja(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\x{4E00}-\x{9FFF}]"), F.lit(False))


def hanja_to_hangul(text: Column, readings: dict[str, str] | None = None) -> Column:
    """Characters of names in their Korean reading: double surnames first, then surnames, then given names, then those of the caller's
    own `readings`, of one syllable each. Other characters stay."""
    for pair, reading in LONG_READINGS.items():
        text = F.replace(text, F.lit(pair), F.lit(reading))
    given = (readings or {}) | GIVEN_READINGS | SURNAME_READINGS
    return F.translate(text, "".join(given), "".join(given.values()))


def surname_length(name: Column) -> Column:
    """0, 1 or 2 syllables that a name begins with and that are a surname."""
    return F.when(name.rlike(f"^(?:{'|'.join(LONG_SURNAMES)})"), 2).when(name.rlike(f"^[{SURNAMES}]"), 1).otherwise(0)


def _code(syllable: Column) -> Column:
    """Place among the syllables, read from the three bytes of UTF-8."""
    byte = lambda i: F.conv(F.substring(F.hex(F.encode(syllable, "UTF-8")), 2 * i - 1, 2), 16, 10).cast("int")
    return (byte(1) - 0xE0) * 4096 + (byte(2) - 0x80) * 64 + (byte(3) - 0x80) - 0xAC00


def _syllable(c: Column) -> Column:
    tables = [F.array(*[F.lit(x) for x in t]) for t in (INITIALS, VOWELS, FINALS)]
    part = lambda n: F.concat(F.get(tables[0], F.floor(n / 588).cast("int")), F.get(tables[1], F.floor(n % 588 / 28).cast("int")), F.get(tables[2], n % 28))
    return F.when(c.rlike("^[가-힣]$"), F.transform(F.array(_code(c)), part)[0]).otherwise(c)


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1000))


def _syllables(name: Column) -> Column:
    return F.filter(F.split(name, ""), lambda c: c != "")


def romanized(name: Column) -> Column:
    """Surname and given name, capitalised; without a known surname each syllable by itself."""
    n, parts = surname_length(name), F.transform(_syllables(name), _syllable)
    two = F.concat_ws(" ", _capital(F.array_join(F.slice(parts, F.lit(1), n), "")), _capital(F.array_join(F.slice(parts, n + 1, F.lit(100)), "")))
    return F.when(n > 0, two).otherwise(F.array_join(F.transform(parts, _capital), " "))


def romanizations(name: Column) -> Column:
    """All usual spellings, the plain one first: hyphen or space within the given name, upper-case surname, given name
    first, comma, all lower, all upper. A name without a surname, or of one alone, has the plain one."""
    n, plain = surname_length(name), romanized(name)
    surname = _capital(F.array_join(F.transform(F.slice(_syllables(name), F.lit(1), n), _syllable), ""))
    given = F.transform(F.slice(_syllables(name), n + 1, F.lit(100)), lambda c: _capital(_syllable(c)))
    whole = _capital(F.lower(F.array_join(given, "")))
    every = F.array(
        plain, F.concat_ws(" ", surname, F.array_join(given, "-")), F.concat_ws(" ", surname, F.array_join(given, " ")), F.concat_ws(" ", F.upper(surname), whole),
        F.concat_ws(" ", whole, surname), F.concat_ws(",", surname, whole), F.lower(plain), F.upper(plain),
    )
    return F.when((n > 0) & (F.length(name) > n), F.array_distinct(every)).otherwise(F.array(plain))


def name_origin(name: Column) -> Column:
    """korean, foreign or unknown."""
    korean = (surname_length(name) > 0) & F.length(name).between(2, 4)
    foreign = name.rlike(f"^[{FOREIGN_FIRST}]") | ((surname_length(name) == 0) & name.rlike(f"[{FOREIGN_SYLLABLES}]"))
    out = F.when(F.length(name) >= 5, "foreign").when(korean, "korean").when(foreign, "foreign").otherwise("unknown")
    return F.when(F.coalesce(name.rlike("^[가-힣]+$"), F.lit(False)), out).otherwise("unknown")


def full_name(name: Column, korean_only: bool = False) -> Column:
    """Three to five syllables, of Korean origin if asked for."""
    whole = F.coalesce(name.rlike("^[가-힣]{3,5}$"), F.lit(False))
    return whole & (name_origin(name) == "korean") if korean_only else whole


def could_be_name(token: Column) -> Column:
    """Three syllables, a surname first and no ending of an office or a place last."""
    return F.coalesce(token.rlike(f"^[{SURNAMES}][가-힣](?![{ADMIN_SUFFIXES}])[가-힣]$"), F.lit(False))
