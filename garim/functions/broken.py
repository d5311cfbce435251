"""Texts whose lines and fields broke on the way out of a file: digits spaced one by one, lines cut in words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garim.functions import offsets

_EDGE = r"(?<![0-9A-Za-z\-])"
#: Digits in boxes of their own, or groups of spaced digits around a hyphen; the first counts where both fit.
SPACED = rf"{_EDGE}[0-9](?: [0-9\-]){{4,}}(?![0-9A-Za-z\-]| [0-9\-])|{_EDGE}[0-9][0-9 ]{{2,}}\s*-\s*[0-9 ]+\s*-?\s*[0-9 ]{{2,}}[0-9](?![0-9])"
#: What a line break within a word or a number stands between.
IN_WORD = r"(?<=[가-힣])\n(?=[가-힣])"
IN_NUMBER = r"(?<=[0-9-])\n(?=[0-9-])|(?<=[A-Za-z])\n(?=[0-9])|(?<=[0-9])\n(?=[A-Za-z])"
SINGLE = r"(?<!\n)\n(?!\n)"


def _blanks(found: Column, gap: Column) -> Column:
    """Runs of spaces of a field, each dropped, or a break within a word. Characters in boxes of their own are one change."""
    size = F.length(found)
    kept = F.transform(F.split(found, " +", -1), F.length)
    gone = F.concat(F.transform(F.regexp_extract_all(found, F.lit(" +"), F.lit(0)), F.length), F.array(F.lit(0)))
    apart = F.concat(F.array(offsets.edit(gap, F.lit(0), F.lit(0))), F.zip_with(kept, gone, lambda k, g: offsets.edit(k, g, F.lit(0))))
    boxes = F.array(offsets.edit(gap, size, F.shiftright(size + 1, 1), 2))
    return F.when(found == "\n", F.array(offsets.edit(gap, F.lit(1), F.lit(0)))).when(found.rlike("^[^ ](?: [^ ])+$"), boxes).otherwise(apart)


def steps(aggressive: bool = False) -> list[Callable[[Column], Column]]:
    """Spaced fields together; no break within a word, a space for one within a number, and for any single one if
    aggressive. Steps of `offsets`, whose ends of spans are those of their last characters."""
    return [
        # Fields hold no letters, so no break within a word is part of one or comes about by joining one: both at once.
        lambda s: offsets.rewrite(s, f"{SPACED}|{IN_WORD}", lambda m: F.when(m == "\n", F.lit("")).otherwise(F.replace(m, F.lit(" "), F.lit(""))), _blanks, last=True),
        lambda s: offsets.rewrite(s, SINGLE if aggressive else IN_NUMBER, lambda m: F.lit(" "), same=True),
    ]


def with_repaired(df: DataFrame, text: str = "text", name: str = "whole", aggressive: bool = False) -> DataFrame:
    """df with a state of `offsets`: the repaired text and its way back. Null stays null."""
    return offsets.with_steps(df, text, name, steps(aggressive))


def repaired(text: Column, aggressive: bool = False) -> Column:
    """The repaired text alone, without a way back. Null stays null."""
    found = F.transform(F.regexp_extract_all(text, F.lit(SPACED), F.lit(0)), lambda m: F.replace(m, F.lit(" "), F.lit("")))
    turns = F.transform(F.array(found), lambda f: F.array_join(F.flatten(F.zip_with(F.split(text, SPACED, -1), f, lambda gap, m: F.array(gap, F.coalesce(m, F.lit(""))))), ""))
    unspaced = F.when(text.rlike(SPACED), turns[0]).otherwise(text)
    return F.regexp_replace(F.regexp_replace(unspaced, IN_WORD, ""), SINGLE if aggressive else IN_NUMBER, " ")


def sentence_ids(text: Column, starts: Column) -> Column:
    """For each place the number of sentence ends (. ! ? or a line's end) before it."""
    return F.transform(starts, lambda s: F.length(F.regexp_replace(F.substring(text, F.lit(1), s), r"[^.!?\n]", "")))
