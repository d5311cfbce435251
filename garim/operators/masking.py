"""What takes the place of a value: names, asterisks, partial masks, hashes, generalisations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garim.functions import spans as S
from garim.functions.checks import digits
from garim.functions.labels import action, ko_name

STRATEGIES = ("redact", "asterisk", "fixed", "partial", "hashed")


def stars(count: Column | int) -> Column:
    return F.repeat(F.lit("*"), F.greatest(F.lit(count) if isinstance(count, int) else count, F.lit(0)))


def _phone(v: Column) -> Column:
    d = digits(v)
    n = F.length(d)
    sep = F.when(v.contains("-"), "-").when(v.contains("."), ".").when(v.contains(" "), " ").otherwise("")
    last = F.right(d, F.lit(4))
    abroad, rest = v.startswith("+") & d.startswith("82"), F.substring(d, 3, 100)
    sub = lambda skip: F.length(rest) - skip - 4
    join = lambda *parts: F.concat_ws("", *[p for part in parts for p in (part, sep)][:-1])
    return (
        F.when(n < 7, stars(F.length(v)))
        .when(abroad & rest.startswith("2"), join(F.lit("+82"), F.lit("2"), stars(F.greatest(F.lit(3), sub(1))), last))
        .when(abroad & (F.length(rest) >= 9), join(F.lit("+82"), F.substring(rest, 1, 2), stars(F.greatest(F.lit(3), sub(2))), last))
        .when(d.startswith("050") & (n == 12), join(F.substring(d, 1, 4), stars(4), last))
        .when(d.startswith("02") & n.isin(9, 10), join(F.lit("02"), stars(n - 6), last))
        .when((n == 8) & d.rlike("^1[568]"), join(F.substring(d, 1, 4), stars(4)))
        .when(n >= 11, join(F.substring(d, 1, 3), stars(4), last))
        .when(n == 10, join(F.substring(d, 1, 3), stars(3), last))
        .when(n == 9, join(F.substring(d, 1, 2), stars(3), last))
        .otherwise(stars(F.length(v)))
    )


def _resident(v: Column) -> Column:
    d = digits(v)
    dash = F.when(v.contains("-"), "-").otherwise("")
    return F.when(F.length(d) != 13, stars(F.length(v))).otherwise(F.concat(F.substring(d, 1, 6), dash, F.substring(d, 7, 1), stars(6)))


def _email(v: Column) -> Column:
    local, domain = F.substring_index(v, "@", 1), F.expr("1")
    domain = F.regexp_extract(v, "^[^@]*@(.*)$", 1)
    n = F.length(local)
    return (
        F.when(~v.contains("@"), stars(F.length(v)))
        .when(n == 0, v)
        .when(n == 1, F.concat(local, stars(3), F.lit("@"), domain))
        .otherwise(F.concat(F.substring(local, 1, 1), stars(F.greatest(F.lit(3), n - 1)), F.lit("@"), domain))
    )


def _card(v: Column) -> Column:
    d = digits(v)
    n = F.length(d)
    sep = F.when(v.contains("-"), "-").when(v.contains(" "), " ").otherwise("")
    groups = F.transform(F.sequence(F.lit(4), F.greatest(n - 5, F.lit(4)), F.lit(4)), lambda i: stars(F.least(F.lit(4), n - 4 - i)))
    parted = F.concat_ws("-", F.substring(d, 1, 4), F.array_join(F.filter(groups, lambda g: g != ""), "-"), F.right(d, F.lit(4)))
    return (
        F.when(n < 8, stars(F.length(v)))
        .when(sep == "", F.concat(F.substring(d, 1, 4), stars(n - 8), F.right(d, F.lit(4))))
        .otherwise(F.replace(F.regexp_replace(parted, "--", "-"), F.lit("-"), sep))
    )


def _account(v: Column) -> Column:
    d = digits(v)
    return F.when(F.length(d) < 8, stars(F.length(v))).otherwise(F.concat(F.substring(d, 1, 4), stars(F.length(d) - 8), F.right(d, F.lit(4))))


def _passport(v: Column) -> Column:
    n = F.length(F.regexp_extract(v, "[0-9]+$", 0))
    return F.when(~v.rlike("^[A-Z]{1,2}[0-9]+$"), stars(F.length(v))).otherwise(
        F.concat(F.regexp_extract(v, "^[A-Z]{1,2}", 0), stars(n - 2), F.right(v, F.least(n, F.lit(2))))
    )


def _birth(v: Column) -> Column:
    korean, numeric = r"^([0-9]{2,4})\s*년\s*[0-9]{1,2}\s*월\s*[0-9]{1,2}\s*일$", r"^([0-9]{2,4})([./-])[0-9]{1,2}\2[0-9]{1,2}$"
    return (
        F.when(v.endswith("년생"), v)
        .when(v.rlike(korean), F.concat(F.regexp_extract(v, korean, 1), F.lit("년 **월 **일")))
        .when(v.rlike(numeric), F.regexp_replace(v, numeric, "$1$2**$2**"))
        .otherwise(stars(F.length(v)))
    )


def _age(v: Column) -> Column:
    age = F.regexp_extract(v, "[0-9]+", 0).try_cast("int")
    return F.when(age.isNull(), stars(F.length(v))).when(age < 10, "10대 미만").otherwise(F.concat((F.floor(age / 10) * 10).cast("string"), F.lit("대")))


def _binned(unit: str, metres: bool) -> Callable[[Column], Column]:
    def mask(v: Column) -> Column:
        number = F.regexp_extract(v, r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")
        number = F.when(number < 3, number * 100).otherwise(number) if metres else number
        low = (F.floor(number / 5) * 5).cast("int")
        return F.when(number.isNull(), stars(F.length(v))).otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 5).cast("string"), F.lit(unit)))

    return mask


def _education(v: Column) -> Column:
    suffix = F.regexp_extract(v, "(?:대학원대학교|전문대학|대학교|대학)$", 0)
    return F.when(suffix == "", stars(F.length(v))).otherwise(F.concat(F.lit("○"), suffix))


def _major(v: Column) -> Column:
    suffix = F.regexp_extract(v, "(?<=.)(?:학과|학부|전공|학|과)$", 0)
    return F.when(suffix == "", stars(F.length(v))).otherwise(F.concat(F.repeat(F.lit("○"), F.length(v) - F.length(suffix)), suffix))


def _person(v: Column) -> Column:
    """The surname stays; two-syllable surnames come first."""
    n = F.when(v.rlike("^(?:남궁|독고|동방|망절|사공|서문|선우|소봉|어금|장곡|제갈|황보|황목)"), 2).otherwise(1)
    return F.concat(F.substring(v, F.lit(1), n), F.repeat(F.lit("O"), F.greatest(F.length(v) - n, F.lit(0))))


def _other(v: Column) -> Column:
    n = F.length(v)
    return F.when(n <= 4, stars(n)).otherwise(F.concat(F.substring(v, 1, 2), stars(n - 4), F.right(v, F.lit(2))))


MASKS: dict[str, Callable[[Column], Column]] = {
    "RRN": _resident, "FRN": _resident, "PHONE": _phone, "FAX": _phone, "EMAIL": _email, "CARD": _card, "PERSON": _person,
    "ACCOUNT": _account, "PASSPORT": _passport, "DT_BIRTH": _birth, "EDUCATION": _education, "MAJOR": _major,
    "POSITION": lambda v: v, "AGE": _age, "HEIGHT": _binned("cm", True), "WEIGHT": _binned("kg", False),
}


def partial_mask(label: Column, value: Column) -> Column:
    out = None
    for name, mask in MASKS.items():
        out = F.when(label == name, mask(value)) if out is None else out.when(label == name, mask(value))
    return out.otherwise(_other(value))


def fingerprint(label: Column, value: Column, salt: str) -> Column:
    """The legacy digest: SHA-256 of salt, label and value."""
    return F.sha2(F.concat_ws(":", F.lit(salt), label, value), 256)


def substitute(label: Column, value: Column, strategy: str, salt: str = "") -> Column:
    if strategy == "redact":
        return F.concat(F.lit("["), ko_name(label), F.lit("]"))
    if strategy == "asterisk":
        return stars(F.greatest(F.length(value), F.lit(1)))
    if strategy == "fixed":
        return F.lit("***")
    if strategy == "partial":
        return partial_mask(label, value)
    if strategy == "hashed":
        return F.concat(F.lit("<"), label, F.lit(":"), F.substring(fingerprint(label, value, salt), 1, 12), F.lit(">"))
    raise ValueError(f"unknown strategy {strategy}")


def with_actions(df: DataFrame, mode: str, spans: str = "spans") -> DataFrame:
    """df whose spans carry an action under the mode."""
    return df.withColumn(spans, F.transform(spans, lambda s: s.withField("action", action(s["risk_level"], s["confidence"], mode))))


def mask_text(df: DataFrame, strategy: str, text: str = "text", spans: str = "spans", name: str = "text_out", salt: str = "") -> DataFrame:
    """df with its blocked spans replaced."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    blocked = F.filter(spans, lambda s: s["action"] == "BLOCK")
    replaced = S.splice(F.col(text), blocked, lambda s: substitute(s["label"], s["text"], strategy, salt))
    return df.withColumn(name, F.when(F.size(blocked) > 0, replaced).otherwise(F.col(text)))


def generalize_age(age: Column, bucket: int = 10) -> Column:
    if bucket <= 0:
        raise ValueError("bucket must be positive")
    band = F.concat((F.floor(age / bucket) * bucket).cast("string"), F.lit("대"))
    return F.when(age < 0, F.raise_error(F.lit("age must not be negative"))).otherwise(band)


def generalize_date(day: Column, precision: str = "month") -> Column:
    if precision == "year":
        return F.date_format(day, "yyyy")
    if precision == "month":
        return F.date_format(day, "yyyy-MM")
    if precision == "decade":
        return F.concat((F.floor(F.year(day) / 10) * 10).cast("string"), F.lit("년대"))
    raise ValueError(f"unknown precision {precision}")


# Words of occupations and the group that they stand for, in the order in which they count.
OCCUPATIONS = (
    ("장관 차관 실장 국장 과장 주무관 서기관 사무관 주사 주사보", "공무원"),
    ("대표이사 이사 임원 사장 부사장 전무 상무", "경영진"),
    ("교수 부교수 조교수 강사 박사후연구원 선임연구원 책임연구원 수석연구원", "연구/학계"),
    ("의사 전문의 수련의 간호사 약사 한의사", "의료"),
    ("판사 검사 변호사 법무사", "법조"),
    ("회계사 세무사 감정평가사", "회계/세무"),
    ("선생 교사", "교사"),
)


def generalize_occupation(title: Column) -> Column:
    out = F.when(F.lit(False), title)
    for words, group in OCCUPATIONS:
        out = out.when(title.rlike("|".join(words.split())), group)
    return out.otherwise(title)


def generalize_address(address: Column, level: str = "city") -> Column:
    """The province or great city, and with level `district` the district after it."""
    if level not in ("city", "district"):
        raise ValueError(f"unknown level {level}")
    city_pattern = "[가-힣]+(?:특별시|광역시|특별자치도|특별자치시|도)"
    city = F.regexp_extract(address, f"({city_pattern})", 1)
    if level == "city":
        return F.when(city == "", address).otherwise(city)
    rest = F.when(city == "", address).otherwise(F.regexp_replace(address, f"^(?s).*?{city_pattern}", ""))
    district = F.regexp_extract(rest, "([가-힣]+(?:시|군|구))", 1)
    both = F.concat_ws(" ", F.when(city != "", city), F.when(district != "", district))
    return F.when(both == "", address).otherwise(both)


def _address(v: Column) -> Column:
    wide = generalize_address(v, "district")
    return F.when(wide == v, stars(F.length(v))).otherwise(F.concat(wide, F.lit(" ***")))


MASKS["ADDRESS"] = _address
