"""Texts rewritten step by step, with maps that lead places of the result back to the source.

A state is (text, maps). A step that changes lengths adds a map of its own: runs (at, source, step), sorted by `at`,
each for the places of the result from `at` on. A place lies `step` times its distance from `at` beyond `source`: step 1 for
text that was kept, 0 for what stands for one stretch of the source as a whole, 2 for characters every other of which was dropped. So a map has a few runs for each change, however
long the text is, and a place is looked up by binary search. Steps chain: maps are kept in their order and followed from the last
to the first. A step that changes nothing, or only characters one for one, adds none.

`last` tells how a map leads back the end of a span: to the end of the source of the span's last character, or else to the source
of the character after it, so that what was dropped in between belongs to the span.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garim.functions import spans as S
from garim.functions.spans import bound, running

#: Changes that one fold adds up; of more, whose array would be copied for each, running sums are taken.
_FEW = 256
RUN = "struct<at:int,source:int,step:int>"
MAP = f"struct<runs:array<{RUN}>,last:boolean,size:int>"
STATE = f"struct<text:string,maps:array<{MAP}>>"


def start(text: Column) -> Column:
    """The state of a text that nothing has changed yet."""
    return F.struct(text.alias("text"), F.expr(f"cast(array() as array<{MAP}>)").alias("maps"))


def edit(gap: Column, taken: Column, put: Column, step: int = 0) -> Column:
    """A change: after `gap` kept characters, `put` characters stand for `taken`, each `step` beyond the one before."""
    return F.struct(gap.cast("int").alias("gap"), taken.cast("int").alias("taken"), put.cast("int").alias("put"), F.lit(step).alias("step"))


def runs(edits: Column) -> Column:
    """The runs of a map, of all changes of a text in their order; the first run begins at 0."""

    def run(at: Column, source: Column, step: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), source.cast("int").alias("source"), step.alias("step"))

    def placed(every: Column) -> Column:
        sources = running(F.transform(every, lambda e: e["gap"] + e["taken"]))
        places = running(F.transform(every, lambda e: e["gap"] + e["put"]))
        known = F.zip_with(F.zip_with(every, places, lambda e, p: F.struct(e.alias("e"), p.alias("p"))), sources, lambda x, s: F.struct(x["e"].alias("e"), x["p"].alias("p"), s.alias("s")))

        def of(x: Column) -> Column:
            e, at, source = x["e"], x["p"] + x["e"]["gap"], x["s"] + x["e"]["gap"]
            after = run(at + e["put"], source + e["taken"], F.lit(1))
            moved = (e["taken"] != e["put"]) | (e["taken"] > 1)
            return F.when(moved & (e["put"] > 0), F.array(run(at, source, e["step"]), after)).when(moved, F.array(after)).otherwise(F.expr(f"cast(array() as array<{RUN}>)"))

        return F.concat(F.array(first), F.flatten(F.transform(known, of)))

    def grow(s: Column, e: Column) -> Column:
        at, source = s["at"] + e["gap"], s["source"] + e["gap"]
        after = run(at + e["put"], source + e["taken"], F.lit(1))
        moved = (e["taken"] != e["put"]) | (e["taken"] > 1)
        more = F.when(e["put"] > 0, F.array(run(at, source, e["step"]), after)).otherwise(F.array(after))
        return F.struct((at + e["put"]).alias("at"), (source + e["taken"]).alias("source"), F.when(moved, F.concat(s["runs"], more)).otherwise(s["runs"]).alias("runs"))

    first = run(F.lit(0), F.lit(0), F.lit(1))
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("source"), F.array(first).alias("runs"))
    few = lambda every: F.aggregate(every, begin, grow, lambda s: s["runs"])
    return bound(edits, lambda every: F.when(F.size(every) <= _FEW, few(every)).otherwise(placed(every)))


def rewrite(state: Column, pattern: str, put: Callable[[Column], Column], edits: Callable[[Column, Column], Column] | None = None, last: bool = False, same: bool = False) -> Column:
    """The state with every match of the pattern replaced. `edits` gives the changes of a match after a gap of so many characters;
    if it isn't given, the match is one change. `same`: characters are replaced one for one. Null text stays null.
    The state is mentioned several times: it should be a column or bound."""

    def changed(s: Column) -> Column:
        text = s["text"]

        def of_turns(turns: Column, rest: Column) -> Column:
            out = F.concat(F.array_join(F.transform(turns, lambda t: F.concat(t["gap"], t["put"])), ""), rest)
            if same:
                return F.struct(out.alias("text"), s["maps"].alias("maps"))
            if edits:
                every = F.flatten(F.transform(turns, lambda t: edits(t["found"], F.length(t["gap"]))))
            else:
                every = F.transform(turns, lambda t: edit(F.length(t["gap"]), F.length(t["found"]), F.length(t["put"])))
            added = lambda r: F.array(F.struct(r.alias("runs"), F.lit(last).alias("last"), F.length(text).alias("size")))
            maps = bound(runs(every), lambda r: F.when(F.size(r) > 1, F.concat(s["maps"], added(r))).otherwise(s["maps"]))
            return F.struct(out.alias("text"), maps.alias("maps"))

        def of_cut(cut: Column) -> Column:
            turn = lambda i: F.struct(F.get(cut, i - 1).alias("gap"), F.get(cut, i).alias("found"), put(F.get(cut, i)).alias("put"))
            every = F.transform(F.sequence(F.lit(1), F.size(cut) - 1, F.lit(2)), turn)
            return bound(every, lambda t: of_turns(t, F.element_at(cut, -1)))

        return bound(S.turns(text, pattern), of_cut)

    return F.when(state["text"].rlike(pattern), changed(state)).otherwise(state)


def with_steps(df: DataFrame, text: str, name: str, steps: list[Callable[[Column], Column]]) -> DataFrame:
    """df with the state of a text after all steps, each a column of its own: the analyzer takes a round for each level of lambdas."""
    df = df.withColumn(name, start(F.col(text)))
    for step in steps:
        df = df.withColumn(name, step(F.col(name)))
    return df


def looked_up(runs_: Column, place: Column) -> Column:
    """The source of a place, by binary search for the last run that begins no later."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(runs_) + 1)).cast("int"))
    begin = F.struct(F.lit(0).alias("low"), (F.size(runs_) - 1).alias("high"))

    def halved(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"] + 1, 1)
        before = F.get(runs_, middle)["at"] <= place
        return F.struct(F.when(before, middle).otherwise(s["low"]).alias("low"), F.when(before, s["high"]).otherwise(F.greatest(middle - 1, s["low"])).alias("high"))

    def of(run: Column) -> Column:
        return run["source"] + run["step"] * (place - run["at"])

    # Of a few runs the last that begins no later is told sooner by looking at each.
    few = F.element_at(F.filter(runs_, lambda r: r["at"] <= place), -1)
    return bound(F.when(F.size(runs_) <= 8, few).otherwise(F.get(runs_, F.aggregate(steps, begin, halved, lambda s: s["low"]))), of)


def _back(places: Column, m: Column, length: Column) -> Column:
    """(start, end, length of the text they are in) one step back."""
    through = F.when(m["last"], looked_up(m["runs"], F.greatest(places["end"] - 1, F.lit(0))) + 1)
    end = F.when(places["end"] >= length, F.when(m["last"] & (places["end"] > 0), through).otherwise(m["size"])).otherwise(F.coalesce(through, looked_up(m["runs"], places["end"])))
    return F.struct(looked_up(m["runs"], places["start"]).alias("start"), end.alias("end"), m["size"].alias("length"))


def to_source(spans: Column, state: Column, source: Column) -> Column:
    """Spans over a state's text as spans over its source."""

    def back(s: Column) -> Column:
        begin = F.struct(s["start"].alias("start"), s["end"].alias("end"), F.length(state["text"]).alias("length"))
        found = F.aggregate(F.reverse(state["maps"]), begin, lambda places, m: _back(places, m, places["length"]))
        return bound(found, lambda p: s.withField("start", p["start"]).withField("end", p["end"]).withField("text", F.substring(source, p["start"] + 1, p["end"] - p["start"])))

    # Without a map only characters were replaced, one for one.
    plain = lambda s: s.withField("text", F.substring(source, s["start"] + 1, s["end"] - s["start"]))
    moved = F.when(F.size(state["maps"]) > 0, F.transform(spans, back)).otherwise(F.transform(spans, plain))
    return F.when(state["text"] == source, spans).otherwise(moved)
