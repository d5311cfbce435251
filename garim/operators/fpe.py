"""Values of the same format: each character is drawn anew from a keyed digest of the value and its place.

Digits become digits, letters letters of the same case, syllables syllables; anything else stays. Some places
are kept (the seventh digit of a resident's number, an area code, a card's issuer, a mail domain, a passport's
letters), and check digits are made to fit. All of it is Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garim.functions import checks as C

_LAST_DIGIT = "[0-9](?=[^0-9]*$)"


def _draw(seed: Column, place: Column, below: int) -> Column:
    """A number from 0, the same for the same seed and place."""
    digest = F.sha2(F.concat_ws(":", seed, place.cast("string")), 256)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % below).cast("int")


def _letter(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _other(c: Column, seed: Column, place: Column) -> Column:
    """Another character of the same kind."""
    return (
        F.when(c.rlike("[0-9]"), _draw(seed, place, 10).cast("string"))
        .when(c.rlike("[A-Z]"), _letter(_draw(seed, place, 26) + 65))
        .when(c.rlike("[a-z]"), _letter(_draw(seed, place, 26) + 97))
        .when(c.rlike("[가-힣]"), _letter(_draw(seed, place, 11172) + 0xAC00))
        .otherwise(c)
    )


def _kept(label: Column, value: Column) -> Column:
    """A pattern of the part at the value's start that stays, and of mail the end."""
    digits = F.length(C.digits(value))
    return (
        F.when(label.isin("PHONE", "FAX") & (digits >= 9), F.length(F.regexp_extract(value, "^[^0-9]*(?:02|[0-9][^0-9]*[0-9][^0-9]*[0-9])", 0)))
        .when((label == "CARD") & (digits >= 13), F.length(F.regexp_extract(value, "^(?:[^0-9]*[0-9]){6}", 0)))
        .when(label == "PASSPORT", F.length(F.regexp_extract(value, "^[A-Za-z]*", 0)))
        .otherwise(0)
    )


def disguised(label: Column, value: Column, salt: str) -> Column:
    seed, resident = F.concat_ws(":", F.lit(salt), label, value), label.isin("RRN", "FRN") & (F.length(C.digits(value)) == 13)
    kept = _kept(label, value)
    seventh = F.when(resident, F.length(F.regexp_extract(value, "^(?:[^0-9]*[0-9]){7}", 0))).otherwise(0)
    mail = F.when(label == "EMAIL", F.instr(value, "@")).otherwise(0)

    def drawn(x: Column) -> Column:
        stays = lambda i: (i <= x["kept"]) | (i == x["seventh"]) | ((x["mail"] > 0) & (i >= x["mail"]))
        chars = F.transform(F.split(x["value"], ""), lambda c, i: F.when(stays(i + 1), c).otherwise(_other(c, x["seed"], i)))
        return F.array_join(chars, "")

    parts = F.struct(value.alias("value"), seed.alias("seed"), kept.alias("kept"), seventh.alias("seventh"), mail.alias("mail"))
    fresh = F.transform(F.array(parts), drawn)

    def checked(v: Column) -> Column:
        resident_digit = C.rrn_check(C.digits(v).try_cast("long")).cast("string")
        front = F.regexp_replace(C.digits(v), "[0-9]$", "")
        card_digit = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: C.luhn_valid(F.concat(front, d)))[0]
        return F.when(resident, F.regexp_replace(v, F.lit(_LAST_DIGIT), resident_digit)).when(
            (label == "CARD") & (F.length(C.digits(value)) >= 13), F.regexp_replace(v, F.lit(_LAST_DIGIT), card_digit)
        ).otherwise(v)

    return F.transform(fresh, checked)[0]


def format_preserving(values: DataFrame, salt: str) -> DataFrame:
    """(label, original, fpe_value) of the distinct values of (label, original). Null values are left out."""
    distinct = values.select("label", "original").where("original is not null").distinct()
    return distinct.withColumn("fpe_value", disguised(F.col("label"), F.col("original"), salt))
