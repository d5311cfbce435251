"""Spans of text as arrays of structs, built from Catalyst expressions.

A span is (label, text, start, end, risk_level, confidence, rank): half-open code-point offsets, risk 1 to
5, and the rank of the detector that gave it, which settles ties. Null text has no spans.

A fold that grows an array copies it at each step, and `substring` counts code points from the start of a text, so
positions come from running sums taken in blocks, and pieces of a text from blocks of it: the work on one text grows
in proportion to its length and its spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<label:string,text:string,start:int,end:int,risk_level:int,confidence:double,rank:int>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once: expressions in lambdas are evaluated anew for every mention."""
    return F.transform(F.array(value), use)[0]


#: Entries that are added up at once.
_BLOCK = 256


def running(sizes: Column, joined: Callable[[Column, Column], Column] = lambda a, b: a + b, first: int = 0) -> Column:
    """For each entry of an array what those before it come to (their sum, if nothing else is said); `first` for the first.
    Within blocks and over blocks apart."""
    none = F.array().cast("array<int>")

    def grow(state: Column, size: Column) -> Column:
        return F.struct(joined(state["at"], size).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    begin = F.struct(F.lit(first).alias("at"), none.alias("out"))

    def blocks(every: Column) -> Column:
        count = F.floor((F.size(every) - 1) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda b: F.aggregate(F.slice(every, b * _BLOCK + 1, F.lit(_BLOCK)), begin, grow))

    def together(parts: Column) -> Column:
        starts = F.aggregate(F.transform(parts, lambda p: p["at"]), begin, grow, lambda s: s["out"])
        return F.flatten(F.zip_with(parts, starts, lambda p, at: F.transform(p["out"], lambda x: joined(x, at))))

    # Most arrays are one block. Arrays are bound to variables, so that each is worked out once.
    long = lambda every: bound(blocks(every), together)
    short = lambda every: F.aggregate(every, begin, grow, lambda s: s["out"])
    return bound(sizes, lambda every: F.when(F.size(every) <= _BLOCK, short(every)).when(F.size(every) > 0, long(every)).otherwise(none))


def scan(values: Column, begin: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """What an ordered fold emits: `step` takes the state and an entry and gives a struct of the next `state` and an `out` of the type
    `kind`. The states run through blocks, so no array grows beyond a block's length in steps of one."""
    none, nested = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")

    def grow(held: Column, x: Column) -> Column:
        return bound(step(held["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(held["out"], F.array(r["out"])).alias("out")))

    def over(held: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(held["state"].alias("state"), none.alias("out")), grow)
        return bound(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(held["outs"], F.array(r["out"])).alias("outs")))

    def blocks(every: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / _BLOCK).cast("int")), lambda b: F.slice(every, b * _BLOCK + 1, F.lit(_BLOCK)))

    start = F.struct(begin.alias("state"), nested.alias("outs"))
    run = lambda every: F.aggregate(blocks(every), start, over, lambda h: F.flatten(h["outs"]))
    return bound(values, lambda v: F.when(F.size(v) > 0, run(v)).otherwise(none))


def count_below(ascending: Column, value: Column) -> Column:
    """How many entries of an ascending array are at most `value`, by binary search."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(ascending) + 2)).cast("int"))
    begin = F.struct(F.lit(0).alias("low"), F.size(ascending).alias("high"))

    def halved(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        below = (s["low"] < s["high"]) & (F.get(ascending, middle) <= value)
        return F.struct(F.when(below, middle + 1).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(F.least(middle, s["high"])).alias("high"))

    return F.aggregate(steps, begin, halved, lambda s: s["low"])


def furthest(ends: Column) -> Column:
    """For each entry of an array of places the largest of those before it; -1 for the first."""
    return running(ends, F.greatest, -1)


def exploded(df: DataFrame, *kept, spans: str = "spans", name: str = "s") -> DataFrame:
    """A row for each span. With a plain `explode` the optimizer filters by the array's size below it and works the spans out
    twice, or many times where columns build on one another."""
    return df.select(*kept, F.explode_outer(spans).alias(name)).where(F.col(name).isNotNull())


#: Stands for a match while a text is cut; no character of a text, and if it is one, the text is cut by the pattern.
_CUT = "\uffff"


def pieces(text: Column, pattern: str) -> Column:
    """split(text, pattern, -1): what stands between matches. Spark's split compiles its pattern anew for each text, which costs more than
    matching where a pattern is long; replacing keeps it, and cutting at one character needs none."""
    return F.when(text.contains(_CUT), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, _CUT), _CUT, -1))


def turns(text: Column, pattern: str) -> Column:
    """What stands between matches and the matches, by turns, beginning and ending with what stands between. As in `pieces`, but matches
    are marked and the text is cut at the marks, so that one pass of the pattern does."""
    marked = F.split(F.regexp_replace(text, pattern, f"{_CUT}$0{_CUT}"), _CUT, -1)
    apart = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.array(g, m))
    return F.when(text.contains(_CUT), F.filter(F.flatten(apart), lambda x: x.isNotNull())).otherwise(marked)


def find_all(column: str, pattern: str, lead: int | None = None, value: int = 0, label: str = "", risk: int = 0, confidence: float = 0.0, rank: int = 0) -> Column:
    """A span for each of the leftmost matches that don't overlap. `value` is the group that counts and
    `lead` the one that stands right before it, at the match's start (None: nothing stands there).

    Text between matches and matches take turns, so a match starts at the sum of the lengths before it.
    Written as one SQL expression, since dozens of them are built for a query.
    """
    t, p = f"`{column}`", quoted(pattern)
    apart = f"filter(flatten(zip_with(split({t}, {p}, -1), regexp_extract_all({t}, {p}, 0), (g, m) -> array(g, m))), m -> m is not null)"
    cut = f"case when contains({t}, '\\uFFFF') then {apart} else split(regexp_replace({t}, {p}, '\\uFFFF$0\\uFFFF'), '\\uFFFF', -1) end"  # as `turns`
    turns = "transform(sequence(1, size(w) - 1, 2), i -> named_struct('gap', length(w[i - 1]), 'size', length(w[i]), 'lead', 0, 'value', w[i]))"
    if value:
        turns = f"zip_with({turns}, regexp_extract_all({t}, {p}, {value}), (x, v) -> named_struct('gap', x.gap, 'size', x.size, 'lead', 0, 'value', v))"
    if lead is not None:
        turns = f"zip_with({turns}, regexp_extract_all({t}, {p}, {lead}), (x, l) -> named_struct('gap', x.gap, 'size', x.size, 'lead', length(l), 'value', x.value))"
    start = "s.at + x.gap" if lead is None else "s.at + x.gap + x.lead"
    span = (
        f"named_struct('label', {quoted(label)}, 'text', x.value, 'start', {start}, 'end', {start} + {'length(x.value)' if value else 'x.size'},"
        f" 'risk_level', {risk}, 'confidence', {confidence}D, 'rank', {rank})"
    )
    blocks = f"transform(sequence(0, int((size(b) - 1) / {_BLOCK})), k -> slice(b, k * {_BLOCK} + 1, {_BLOCK}))"
    grow = f"(s, x) -> named_struct('at', s.at + x.gap + x.size, 'out', concat(s.out, array({span})))"
    of_block = f"aggregate(c, named_struct('at', z.at, 'out', {NO_SPANS}), {grow})"
    few = f"aggregate(b, named_struct('at', 0, 'out', {NO_SPANS}), {grow}, s -> s.out)"
    placed = (
        f"aggregate({blocks}, named_struct('at', 0, 'out', cast(array() as array<array<{SPAN}>>)),"
        f" (z, c) -> transform(array({of_block}), r -> named_struct('at', r.at, 'out', concat(z.out, array(r.out))))[0], z -> flatten(z.out))"
    )
    return F.expr(f"case when {t} rlike {p} then transform(array({cut}), w -> transform(array({turns}), b -> case when size(b) <= {_BLOCK} then {few} else {placed} end)[0])[0] else {NO_SPANS} end")


def before(text: Column, start: Column, window: int) -> Column:
    """Up to `window` characters that stand before `start`."""
    return F.substring(text, F.greatest(start - window, F.lit(0)) + 1, F.least(start, F.lit(window)))


def after(text: Column, end: Column, window: int) -> Column:
    return F.substring(text, end + 1, F.lit(window))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def in_order(spans: Column) -> Column:
    """Whether two spans or more stand one behind another as they are, so that none clashes."""
    return ~F.exists(F.sequence(F.lit(1), F.size(spans) - 1), lambda i: F.get(spans, i)["start"] < F.get(spans, i - 1)["end"])


def clusters(spans: Column) -> Column:
    """Spans in runs that overlap one another, run by run in the order of the text; a run's are sorted by place."""

    def cut(placed: Column) -> Column:
        def runs(far: Column) -> Column:
            opens = F.filter(F.sequence(F.lit(0), F.size(placed) - 1), lambda i: F.get(placed, i)["start"] >= F.get(far, i))
            return bound(opens, lambda o: F.zip_with(o, F.concat(F.slice(o, F.lit(2), F.size(o)), F.array(F.size(placed))), lambda a, z: F.slice(placed, a + 1, z - a)))

        return bound(furthest(F.transform(placed, lambda p: p["end"])), runs)

    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("nth"), s.alias("span")))
    return F.flatten(F.transform(F.filter(F.array(F.array_sort(keyed)), lambda p: F.size(p) > 0), cut))


def _one_by_one(ordered: Column, clash: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(
        ordered,
        F.expr(NO_SPANS),
        lambda kept, x: F.when(F.exists(kept, lambda k: clash(k, x)), kept).otherwise(F.concat(kept, F.array(x))),
    )


def _by_place(spans: Column) -> Column:
    placed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s.alias("span"))))
    return F.transform(placed, lambda p: p["span"])


def first_come(spans: Column, clash: Callable[[Column, Column], Column] = overlaps) -> Column:
    """Keep each span, in the array's order, that clashes with none kept so far; the result is in the order of the text.
    Only spans that overlap may clash, so each run of such is settled by itself."""

    def settled(run: Column) -> Column:
        ordered = F.transform(F.array_sort(F.transform(run, lambda p: F.struct(p["nth"].alias("nth"), p["span"].alias("span")))), lambda p: p["span"])
        return F.when(F.size(run) == 1, F.transform(run, lambda p: p["span"])).otherwise(_by_place(_one_by_one(ordered, clash)))

    return bound(spans, lambda s: F.when(F.size(s) < 2, s).when(in_order(s), s).otherwise(F.flatten(F.transform(clusters(s), settled))))


def _priority(s: Column) -> Column:
    return F.struct(
        (-s["risk_level"]).alias("k1"), (-s["confidence"]).alias("k2"), (s["start"] - s["end"]).alias("k3"),
        s["start"].alias("k4"), s["rank"].alias("k5"), s.alias("span"),
    )


#: Runs of more spans are settled on a map of their characters.
_MANY = 32


def _on_a_map(ordered: Column, base: Column, size: Column) -> Column:
    """As `_one_by_one` for overlaps, with taken characters marked in a string of bytes: a span costs no comparisons with
    those kept. The first byte of a kept span is 2 and its last 3 (4 where it has one), so that it is told at the end."""
    blank = lambda n: F.encode(F.repeat(F.lit("0"), n), "utf-8")
    mark = lambda n: F.encode(F.when(n == 1, F.lit("4")).otherwise(F.concat(F.lit("2"), F.repeat(F.lit("1"), n - 2), F.lit("3"))), "utf-8")
    at, width = lambda x: x["start"] - base + 1, lambda x: x["end"] - x["start"]

    def step(taken: Column, x: Column) -> Column:
        free = F.substring(taken, at(x), width(x)) == blank(width(x))
        return F.when(free, F.overlay(taken, mark(width(x)), at(x), width(x))).otherwise(taken)

    def told(taken: Column) -> Column:
        return F.filter(ordered, lambda x: F.substring(taken, at(x), width(x)) == mark(width(x)))

    return bound(F.aggregate(ordered, blank(size), step), told)


def resolve(spans: Column) -> Column:
    """Greedy overlap resolution: risk, then confidence, then length, then place, then rank decide; what
    overlaps a span already taken is dropped. The result is in the order of the text."""

    def settled(run: Column) -> Column:
        ordered = F.transform(F.array_sort(F.transform(run, lambda p: _priority(p["span"]))), lambda k: k["span"])
        # Of spans in one place only the best can be taken.
        best = F.array_sort(F.transform(run, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), _priority(p["span"]).alias("key"))))
        same = lambda b, x, i: (i > 0) & (F.get(b, i - 1)["start"] == x["start"]) & (F.get(b, i - 1)["end"] == x["end"])
        best = bound(best, lambda b: F.filter(b, lambda x, i: ~F.coalesce(same(b, x, i), F.lit(False))))
        best = F.transform(F.array_sort(F.transform(best, lambda x: x["key"])), lambda k: k["span"])
        size = F.array_max(F.transform(run, lambda p: p["end"])) - F.get(run, F.lit(0))["start"]
        many = F.transform(F.array(best), lambda o: _on_a_map(o, F.get(run, F.lit(0))["start"], size))[0]
        taken = F.when(F.size(run) == 1, F.transform(run, lambda p: p["span"])).when(F.size(run) <= _MANY, _one_by_one(ordered, overlaps)).otherwise(many)
        return _by_place(taken)

    return bound(spans, lambda s: F.when(F.size(s) < 2, s).when(in_order(s), s).otherwise(F.flatten(F.transform(clusters(s), settled))))


def merged(spans: Column) -> Column:
    """(start, end) of the runs of spans that overlap or touch, in the order of the text."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def runs(placed: Column) -> Column:
        def joined(far: Column) -> Column:
            opens = F.filter(F.sequence(F.lit(0), F.size(placed) - 1), lambda i: F.get(placed, i)["start"] > F.get(far, i))
            # The furthest end before the next run's first span is the end of this one.
            ends = lambda o: F.concat(F.transform(F.slice(o, F.lit(2), F.size(o)), lambda i: F.get(far, i)), F.array(F.greatest(F.element_at(far, -1), F.element_at(placed, -1)["end"])))
            return bound(opens, lambda o: F.zip_with(o, ends(o), lambda i, end: F.struct(F.get(placed, i)["start"].alias("start"), end.alias("end"))))

        return bound(furthest(F.transform(placed, lambda p: p["end"])), joined)

    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return bound(F.array_sort(keyed), lambda p: F.when(F.size(p) > 0, runs(p)).otherwise(none))


#: Characters of the blocks that pieces of a text are taken from.
_CUT = 512


def cut(text: Column) -> Column:
    """A text in blocks, for `piece`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text that `cut` has cut."""
    block = lambda place: F.coalesce(F.get(blocks, F.floor(place / _CUT).cast("int")), F.lit(""))
    first, last = F.floor(start / _CUT).cast("int"), F.floor(end / _CUT).cast("int")
    short = F.substring(block(start), start % _CUT + 1, end - start)
    between = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    long = F.concat(F.substring(block(start), start % _CUT + 1, F.lit(_CUT)), between, F.substring(block(end), F.lit(1), end % _CUT))
    return F.when(first == last, short).otherwise(long)


def splice(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """text with every span (sorted, disjoint) replaced."""

    def pieces(blocks: Column, every: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(every, lambda s: s["end"]))
        inner = F.zip_with(every, F.slice(ends, F.lit(1), F.size(every)), lambda s, at: F.array(piece(blocks, at, s["start"]), replacement(s)))
        return F.concat(F.flatten(inner), F.array(piece(blocks, F.element_at(every, -1)["end"], F.length(text))))

    done = bound(cut(text), lambda blocks: bound(spans, lambda every: F.array_join(pieces(blocks, every), "")))
    return F.when(F.size(spans) > 0, done).otherwise(text)
