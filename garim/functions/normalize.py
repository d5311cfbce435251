"""Unicode normalisation against evasion, in expressions alone, with a way back to the source.

Invisible characters go, compatibility forms and combining sequences become their NFKC forms, digits of all
scripts, dashes and slashes become ASCII, and Latin letters that stand for digits in numbers become digits. Texts of
ASCII and Hangul syllables alone pass as they are.

Spark has no NFKC, so its tables are read from Python's on the driver and go into the plan: `translate` leads a character to
its place in an array of what stands for it. A base with combining marks or jamo is decomposed, its marks are sorted, and pairs are
composed, in the order that the standard gives; the composite is found in a string of all pairs.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garim.functions import broken, offsets
from garim.functions.spans import bound, running

# What is dropped or folded.
INVISIBLE = frozenset([0xAD, 0x2A74, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070)])
DASHES = "‐‑‒–—―−﹣－⁃﹘ー･・·•⸺⸻"
SLASHES = "⁄∕／⧸"
_FOLD = {**dict.fromkeys(DASHES, "-"), **dict.fromkeys(SLASHES, "/")}
#: Letters that look like digits, and the digits.
LETTERS, DIGITS = "OoQlI|SBZG", "0001115826"
#: A number with two digits at least in which such a letter stands.
_ALIKE = r"OoQlI|SBZG"
NUMBER = rf"(?=[{_ALIKE}\-‐-―]*+[0-9][{_ALIKE}\-‐-―]*+[0-9])(?=[0-9\-‐-―]*+[{_ALIKE}])[0-9{_ALIKE}][0-9{_ALIKE}\-‐-―]*+"

#: Places in tables are written as characters from here on, which are assigned to nothing.
_BASE = 0xF0000
_COMMON = r"\t\n\r\x20-\x7E가-힣"
_LEADS, _VOWELS, _TAILS, _SYLLABLES = 0x1100, 0x1161, 0x11A7, 0xAC00


def _folded(ch: str) -> str:
    if ch in _FOLD:
        return _FOLD[ch]
    kind = unicodedata.category(ch)
    if kind == "Nd":
        return str(unicodedata.decimal(ch))
    if kind == "No" and unicodedata.digit(ch, None) is not None:
        return str(unicodedata.digit(ch))
    return ch


def _dropped(ch: str) -> bool:
    return ord(ch) in INVISIBLE or unicodedata.category(ch) == "Cc" and ch not in "\t\n\r"


def _alone(ch: str) -> str:
    """What stands for a character that no mark follows."""
    if _dropped(ch):
        return ""
    whole = _FOLD.get(ch) or unicodedata.normalize("NFKC", ch)
    if not ch.isalpha():
        whole = "".join(c for c in whole if not unicodedata.combining(c))
    return "".join(map(_folded, whole))


def _class(codes: Iterable[int]) -> str:
    """The inside of a character class of these codes, which ascend."""
    ranges: list[list[int]] = []
    for code in codes:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(rf"\x{{{a:x}}}-\x{{{z:x}}}" for a, z in ranges)


class _Tables:
    def __init__(self):
        every = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cn", "Cs", "Co")]
        alone = {c: _alone(c) for c in every}
        self.alone = {c: t for c, t in alone.items() if t != c}
        self.whole = {c: t for c in every if not _SYLLABLES <= ord(c) <= 0xD7A3 and (t := unicodedata.normalize("NFKD", c)) != c}
        self.order = {c: chr(_BASE + k) for c in every if (k := unicodedata.combining(c))}
        self.fold = {c: t for c in every if (t := _folded(c)) != c}
        self.marks = _class(map(ord, self.order))
        self.odd = _class(map(ord, self.alone))
        # Without marks: characters that one stands for, which a look at the text replaces all at once, and others.
        self.single = {c: t for c, t in self.alone.items() if len(t) == 1 and t not in self.alone and not re.match(f"[{_COMMON}一-鿿]", c)}
        self.rest = {c: t for c, t in self.alone.items() if c not in self.single}
        self.marked = rf"(?=[^\x00-\x{{2ff}}가-힣一-鿿])[{self.marks}\x{{1160}}-\x{{11ff}}]"
        self.letters = _class(ord(c) for c in every if c.isalpha())
        pairs = []
        for c in every:
            parts = unicodedata.decomposition(c).split()
            if len(parts) == 2 and parts[0][0] != "<":
                pair = "".join(chr(int(p, 16)) for p in parts)
                if unicodedata.normalize("NFC", pair) == c:
                    pairs.append("\x01" + pair + c)
        self.pairs = "".join(pairs)
        # A base with marks or jamo after it, or a character that is changed alone; cheap tests come first.
        self.pattern = (
            rf"[\x{{1100}}-\x{{11ff}}][{self.marks}\x{{1160}}-\x{{11ff}}]+"
            rf"|(?s:.)(?=[^\x00-\x{{2ff}}가-힣一-鿿])[{self.marks}]+"
            rf"|(?![{_COMMON}一-鿿])[{self.odd}]"
        )
        self.rest_pattern = rf"(?![{_COMMON}一-鿿])[{_class(map(ord, self.rest))}]"


@lru_cache(maxsize=1)
def _tables() -> _Tables:
    return _Tables()


def _through(table: dict[str, str]) -> Callable[[Column], Column]:
    """The table as a function of one character; others stay."""
    keys = "".join(table)
    places = "".join(chr(_BASE + i) for i in range(len(table)))
    # One literal, once the optimizer has folded it; an array of thousands would be a tree of as many expressions.
    values = F.split(F.lit("\x02".join(table.values())), "\x02", -1)

    def of(ch: Column) -> Column:
        return bound(F.translate(ch, keys, places), lambda t: F.when(t == ch, ch).otherwise(F.get(values, F.ascii(t) - _BASE)))

    return of


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.hex(code)), "UTF-16BE")


def _composed(starter: Column, ch: Column, pairs: str) -> Column:
    """The composite of a starter and a character; null if there is none."""
    s, c = F.ascii(starter), F.ascii(ch)
    syllable = F.when(
        s.between(_LEADS, _LEADS + 18) & c.between(_VOWELS, _VOWELS + 20), (s - _LEADS) * 588 + (c - _VOWELS) * 28 + _SYLLABLES
    ).when(s.between(_SYLLABLES, 0xD7A3) & ((s - _SYLLABLES) % 28 == 0) & c.between(_TAILS + 1, _TAILS + 27), s + c - _TAILS)
    found = F.instr(F.lit(pairs), F.concat(F.lit("\x01"), starter, ch))
    other = F.when((found > 0) & (starter != ""), F.substring(F.lit(pairs), found + 3, F.lit(1)))
    return F.coalesce(_character(syllable), other)


def _cluster(found: Column) -> Column:
    """What stands for a base with marks."""
    tables = _tables()
    whole = _through(tables.whole)
    marks, places = "".join(tables.order), "".join(tables.order.values())

    def order(ch: Column) -> Column:
        return bound(F.translate(ch, marks, places), lambda t: F.when(t == ch, F.lit(0)).otherwise(F.ascii(t) - _BASE))

    def sorted_(chars: Column) -> Column:
        kinds = F.transform(chars, lambda c: F.struct(c.alias("c"), order(c).alias("order")))

        def in_parts(known: Column) -> Column:
            starts = F.transform(known, lambda k: (k["order"] == 0).cast("int"))
            parts = F.zip_with(running(starts), starts, lambda before, own: before + own)
            keyed = F.transform(F.zip_with(known, parts, lambda k, p: F.struct(p.alias("part"), k.alias("k"))), lambda x, i: F.struct(x["part"], x["k"]["order"].alias("order"), i.alias("i"), x["k"]["c"].alias("c")))
            return F.array_sort(keyed)

        return bound(kinds, in_parts)

    def step(s: Column, x: Column) -> Column:
        free = (s["marks"] == "") | (s["last"] < x["order"]) & (x["order"] > 0)
        made = F.when(free, _composed(s["starter"], x["c"], tables.pairs))

        def moved(m: Column) -> Column:
            state = lambda done, starter, rest, last: F.struct(done.alias("done"), starter.alias("starter"), rest.alias("marks"), last.cast("int").alias("last"))
            begun = state(F.concat(s["done"], s["starter"], s["marks"]), x["c"], F.lit(""), F.lit(0))
            kept = state(s["done"], s["starter"], F.concat(s["marks"], x["c"]), x["order"])
            return F.when(m.isNotNull(), state(s["done"], m, s["marks"], s["last"])).when(x["order"] == 0, begun).otherwise(kept)

        return bound(made, moved)

    begin = F.struct(F.lit("").alias("done"), F.lit("").alias("starter"), F.lit("").alias("marks"), F.lit(0).alias("last"))
    chars = F.flatten(F.transform(F.split(found, ""), lambda c: F.split(whole(c), "")))
    out = F.aggregate(sorted_(chars), begin, step, lambda s: F.concat(s["done"], s["starter"], s["marks"]))
    first = F.substring(found, 1, 1)
    bare = F.when(first.rlike(f"[{tables.letters}]"), out).otherwise(F.regexp_replace(out, f"[{tables.marks}]", ""))
    gone = first.rlike(f"[{_class(sorted(c for c in map(ord, tables.alone) if _dropped(chr(c))))}]")
    return F.when(gone, F.lit("")).otherwise(F.translate(bare, "".join(tables.fold), "".join(tables.fold.values())))


def needs_normalization(text: Column) -> Column:
    """Whether a text has characters beside those of plain ASCII and Hangul syllables."""
    return text.rlike(f"[^{_COMMON}]")


def steps() -> list[Callable[[Column], Column]]:
    """Steps of `offsets`; texts that don't need them pass."""
    tables = _tables()
    alone, rest = _through(tables.alone), _through(tables.rest)
    put = lambda m: F.when(F.length(m) == 1, alone(m)).otherwise(_cluster(m))

    def numbers(s: Column) -> Column:
        return F.when(needs_normalization(s["text"]), offsets.rewrite(s, NUMBER, lambda m: F.translate(m, LETTERS, DIGITS), same=True)).otherwise(s)

    def unmarked(s: Column) -> Column:
        text = F.translate(s["text"], "".join(tables.single), "".join(tables.single.values()))
        return bound(F.struct(text.alias("text"), s["maps"].alias("maps")), lambda x: offsets.rewrite(x, tables.rest_pattern, rest))

    def characters(s: Column) -> Column:
        every = F.when(s["text"].rlike(tables.marked), offsets.rewrite(s, tables.pattern, put)).otherwise(unmarked(s))
        return F.when(needs_normalization(s["text"]), every).otherwise(s)

    return [numbers, characters]


def with_normalized(df: DataFrame, text: str = "text", name: str = "normal", repair_lines: bool = False) -> DataFrame:
    """df with a state of `offsets`: the normalised text, after the repair of broken lines and fields if that is asked for, and
    its way back. Null text stays null."""
    return offsets.with_steps(df, text, name, (broken.steps() if repair_lines else []) + steps())


def detect_normalized(df: DataFrame, text: str = "text", name: str = "spans", repair_lines: bool = False, **options) -> DataFrame:
    """df with spans found in the normalised text, in the source's offsets."""
    from garim.operators.detectors import detect

    normal = with_normalized(df, text, "_normal", repair_lines).withColumn("_text", F.col("_normal.text"))
    found = detect(normal, "_text", "_spans", **options)
    return found.withColumn(name, offsets.to_source(F.col("_spans"), F.col("_normal"), F.col(text))).drop("_normal", "_text", "_spans")
