"""Check digits and dates of Korean identifiers as Column expressions over whole numbers.

An identifier's digits are read as one number; places are taken from it by division, so that a check costs
arithmetic alone. Leading zeros count through `size`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights that the identifiers' issuers publish.
RRN_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
BUSINESS_WEIGHTS = (1, 3, 7, 1, 3, 7, 1, 3, 5)
CORPORATE_WEIGHTS = (1, 2) * 6


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def places(number: Column, first: int, last: int, size: int) -> Column:
    """The number that stands at the places `first` to `last`, from 1, of one of `size` digits."""
    front = F.call_function("div", number, F.lit(10 ** (size - last)).cast("long")) if last < size else number
    return front % F.lit(10 ** (last - first + 1)).cast("long") if first > 1 else front


def digit(number: Column, place: int, size: int) -> Column:
    return places(number, place, place, size)


def weighted(number: Column, weights: tuple[int, ...], size: int) -> Column:
    total = F.lit(0).cast("long")
    for place, weight in enumerate(weights, 1):
        total = total + (digit(number, place, size) * weight if weight > 1 else digit(number, place, size))
    return total


def rrn_check(number: Column) -> Column:
    """The check digit of a number of 13 digits, whatever its last."""
    return (11 - weighted(number, RRN_WEIGHTS, 13) % 11) % 10


def rrn_valid(number: Column) -> Column:
    return rrn_check(number) == digit(number, 13, 13)


def business_valid(number: Column) -> Column:
    total = weighted(number, BUSINESS_WEIGHTS, 10) + F.call_function("div", digit(number, 9, 10) * 5, F.lit(10))
    return ((10 - total % 10) % 10 == digit(number, 10, 10)) & (number != 0)


def corporate_valid(number: Column) -> Column:
    return (10 - weighted(number, CORPORATE_WEIGHTS, 13) % 10) % 10 == digit(number, 13, 13)


def luhn_valid(value: Column) -> Column:
    return F.call_function("luhn_check", value)


def day_exists(year: Column, month: Column, day: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return month.between(1, 12) & (day >= 1) & (day <= last)


def birth_day(number: Column, centuries: dict[int, int]) -> Column:
    """Date of birth as yyyymmdd, told by the first seven of 13 digits; null if it is none, or the seventh is no key."""
    seventh, century = digit(number, 7, 13), F.lit(None).cast("long")
    for key, base in centuries.items():
        century = F.when(seventh == key, base).otherwise(century)
    year, month, day = century + places(number, 1, 2, 13), places(number, 3, 4, 13), places(number, 5, 6, 13)
    return F.when(day_exists(year, month, day), year * 10000 + places(number, 3, 6, 13))
