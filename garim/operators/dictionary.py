"""Terms of any dictionary table found in texts, longest first, in one pass over each text.

A dictionary is a table (term, parent): parents tell which terms may stand before another, as a province before its
districts. It is read to the driver, at most `MOST_TERMS` of it, and becomes a trie. Up to `SMALL_TERMS` terms the trie is written
as one pattern, in which terms share their beginnings, and texts are matched in the JVM; beyond that an Aho-Corasick automaton
is built once for each Python worker from a broadcast list, and texts go through it in Arrow batches. Both give the same spans: at each
place the longest term that has no `edge` character on either side; what is inside a term that was found is not looked at.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garim.functions import spans as S

SMALL_TERMS = 2_000
MOST_TERMS = 1_000_000
MOST_CHARACTERS = 32 << 20
#: Texts whose finds are held as Python's objects at once.
AT_ONCE = 256
FOUND = "array<struct<term:string,start:int,end:int>>"


def _escaped(ch: str) -> str:
    return ch if ch.isalnum() or ch in " _" else f"\\x{{{ord(ch):x}}}"


def trie_pattern(terms: list[str]) -> str:
    """A pattern of all terms that tries longer ones first; terms share their beginnings."""
    root: dict = {}
    for term in terms:
        node = root
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = {}

    def written(node: dict) -> str:
        # One branch below another is followed without recursion.
        head = ""
        while len(node) == 1 and "" not in node:
            ch, node = next(iter(node.items()))
            head += _escaped(ch)
        branches = [_escaped(ch) + written(below) for ch, below in sorted(node.items()) if ch]
        if not branches:
            return head
        return head + f"(?:{'|'.join(branches)})" + ("?" if "" in node else "")

    return written(root)


@dataclass(frozen=True)
class Terms:
    """A dictionary in memory; `edge` is the inside of a class of characters that may not stand beside a term."""

    terms: tuple[str, ...]
    edge: str = "가-힣A-Za-z0-9"

    @classmethod
    def of(cls, table: DataFrame, edge: str = "가-힣A-Za-z0-9") -> Terms:
        rows = table.where("term is not null and term <> ''").select("term").distinct().limit(MOST_TERMS + 1).collect()
        if len(rows) > MOST_TERMS or sum(len(r.term) for r in rows) > MOST_CHARACTERS:
            raise ValueError(f"a dictionary has {MOST_TERMS} terms and {MOST_CHARACTERS} characters at most")
        return cls(tuple(sorted(r.term for r in rows)), edge)

    @property
    def pattern(self) -> str:
        return f"(?<![{self.edge}])(?:{trie_pattern(list(self.terms))})(?![{self.edge}])"


def _by_pattern(df: DataFrame, terms: Terms, text: str, name: str) -> DataFrame:
    found = S.find_all(text, terms.pattern)
    return df.withColumn(name, F.transform(found, lambda s: F.struct(s["text"].alias("term"), s["start"].alias("start"), s["end"].alias("end"))))


def _by_automaton(df: DataFrame, terms: Terms, text: str, name: str) -> DataFrame:
    import ahocorasick
    import regex

    listed = df.sparkSession.sparkContext.broadcast(terms.terms)
    edge = f"[{terms.edge}]"

    @F.arrow_udf(FOUND)
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton, beside = ahocorasick.Automaton(), regex.compile(edge)
        for term in listed.value:
            automaton.add_word(term, len(term))
        automaton.make_automaton()

        def of(part: pa.Array) -> pa.Array:
            # Flat columns of numbers: an object for each find of a batch took gigabytes.
            terms_, starts, ends, bounds = [], array("i"), array("i"), array("i", [0])
            for value in part:
                t, at = value.as_py() or "", 0
                hits = [(end - size + 1, -size) for end, size in automaton.iter(t)]
                for start, size in sorted(hits):
                    end = start - size
                    if start >= at and not (start and beside.match(t[start - 1])) and not (end < len(t) and beside.match(t[end])):
                        terms_.append(t[start:end])
                        starts.append(start)
                        ends.append(end)
                        at = end
                bounds.append(len(starts))
            columns = [pa.array(terms_, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, ["term", "start", "end"]))

        for batch in texts:
            parts = [of(batch.slice(i, AT_ONCE)) for i in range(0, len(batch), AT_ONCE)]
            yield pa.concat_arrays(parts) if parts else of(batch)

    return df.withColumn(name, found(F.col(text)))


def with_terms(df: DataFrame, terms: Terms, text: str = "text", name: str = "terms") -> DataFrame:
    """df with an array (term, start, end) in the order of the text. Null text has none; a column with the name is replaced."""
    if not terms.terms:
        return df.withColumn(name, F.expr(f"cast(array() as {FOUND})"))
    return (_by_pattern if len(terms.terms) <= SMALL_TERMS else _by_automaton)(df, terms, text, name)


def follows(found: Column, most: int) -> Column:
    """(first, second, start, end) of terms that stand beside each other, at most so many characters apart."""
    pairs = F.zip_with(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))), F.slice(found, F.lit(2), F.size(found)), lambda a, b: F.struct(a["term"].alias("first"), b["term"].alias("second"), a["start"].alias("start"), b["end"].alias("end"), (b["start"] - a["end"]).alias("apart")))
    return F.filter(pairs, lambda p: p["apart"] <= most)


def known_pairs(df: DataFrame, table: DataFrame, text: str = "text", most: int = 1, edge: str = "가-힣A-Za-z0-9") -> DataFrame:
    """df's other columns with a row (first, second, start, end, valid) for each two terms side by side; valid where the table has the
    first as a parent of the second. The check is a join with the table, whatever its size."""
    found = with_terms(df, Terms.of(table, edge), text, "_terms")
    kept = [F.col(c) for c in df.columns if c != text]
    rows = found.select(*kept, F.inline(follows(F.col("_terms"), most))).drop("apart")
    parents = table.select(F.col("term").alias("second"), F.col("parent").alias("first"), F.lit(True).alias("known")).where("first is not null").distinct()
    return rows.join(parents, ["first", "second"], "left").select(*kept, "first", "second", "start", "end", F.coalesce("known", F.lit(False)).alias("valid"))
