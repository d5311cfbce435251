"""Secret scan in DataFrame functions alone: fixed patterns, and entropy over sliding windows.

Base spans come from three patterns (`assign`, `access`, `hex`). Besides, every run of at least
`WINDOW` token characters is a candidate string. A window of `WINDOW` characters slides over it and carries the
count of each character, and the sum of n * log2(n) over these counts; both are kept up to date from the
character that leaves and the one that enters. Windows whose Shannon entropy reaches the limit of the
candidate's character class (hex, letters and digits, base64) are hot; hot windows that touch make one `entropy`
span. Candidates on the allow list (`ALLOWED`: runs of letters that look like words, numbers, UUIDs) are
suppressed, and so are hot spans with a placeholder in them, unless a path part of `WINDOW` characters or more has
none. Base spans are cut out of hot spans and stay as they
are; what is left of a hot span counts if it has at least `LEAST_LEFT` characters.

The sum is kept in whole millionths, so that it doesn't drift. Null text counts as empty; an empty text has no
spans; a repeated row has its spans again. Offsets are code points, ends exclusive. All work stays in the row: no
shuffle, and time in proportion to a text's length.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garim.functions.spans import merged, running, splice

# The base patterns. The last two match at once what has the least length, with the same spans.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_ASSIGN = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
LETTERS = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/_=-"
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Character classes of candidates, narrowest first, and the entropy in bits that makes a window hot.
CLASSES = ((r"^[0-9a-fA-F]+$", 3.0), (r"^[A-Za-z0-9]+$", 3.65), (r"", 3.85))
ALLOWED = (
    r"^[-_/=+]*+(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[A-Za-z](?![A-Za-z]))[-_/=+]*+)*+$|^[-_/=+0-9]++$"
    r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
)
PLACEHOLDER = r"(?i)example|placeholder|dummy|sample|xxxx|your[-_]"
LEAST_LEFT = 8
_UNIT = 1_000_000
_SUMS = [round(_UNIT * n * math.log2(n)) if n else 0 for n in range(WINDOW + 2)]
#: Counts of that many letters stand in one long.
_BITS, _PACKED = 5, 12
NO_SPANS = "cast(array() as array<struct<start:int,kind:int,end:int>>)"


def _limit(bits: float) -> int:
    """The largest sum of n * log2(n) that a window of this entropy has."""
    return math.floor(_UNIT * WINDOW * (math.log2(WINDOW) - bits))


def matches(text: Column, pattern: str) -> Column:
    """(start, end, found) of all leftmost matches that don't overlap. The text between matches and the
    matches take turns, so positions are sums of lengths."""
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        turns = F.zip_with(found, between, lambda m, g: F.struct(m.alias("found"), F.length(g).alias("gap"), F.length(m).alias("size")))

        def of_turns(t: Column) -> Column:
            starts = running(F.transform(t, lambda x: x["gap"] + x["size"]))
            start = lambda x, at: at + x["gap"]
            return F.zip_with(t, starts, lambda x, at: F.struct(start(x, at).alias("start"), (start(x, at) + x["size"]).alias("end"), x["found"].alias("found")))

        return F.transform(F.array(turns), of_turns)[0]

    found = F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), placed)[0]
    return F.when(text.rlike(pattern), found).otherwise(none)


def _kind(found: Column, number: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")))


def hot_windows(letters: Column, limit: Column) -> Column:
    """(start, end) within a candidate, given as places in `LETTERS` from 0, of where its entropy reaches the limit.
    Both should be columns or fields: what is computed here is computed anew for each letter."""
    sums = F.array(*[F.lit(s) for s in _SUMS])
    none = F.array().cast("array<struct<start:int,end:int>>")
    longs = [f"c{k}" for k in range(math.ceil(len(LETTERS) / _PACKED))]

    def shift(letter: Column) -> Column:
        return (letter % _PACKED) * _BITS

    def count(state: Column, letter: Column) -> Column:
        held = state[longs[-1]]
        for k, name in reversed(list(enumerate(longs[:-1]))):
            held = F.when(letter < (k + 1) * _PACKED, state[name]).otherwise(held)
        return F.call_function("shiftright", held, shift(letter)).bitwiseAND(F.lit(31)).cast("int")

    def added(state: Column, letter: Column, one: int) -> list[Column]:
        step = F.call_function("shiftleft", F.lit(one).cast("long"), shift(letter))
        word = F.floor(letter / _PACKED)
        return [(state[n] + F.when(word == k, step).otherwise(F.lit(0).cast("long"))).alias(n) for k, n in enumerate(longs)]

    def leave(state: Column, i: Column) -> Column:
        out = F.element_at(letters, i - WINDOW)
        n = count(state, out)
        less = F.struct((state["sum"] + F.element_at(sums, n) - F.element_at(sums, n + 1)).alias("sum"), *added(state, out, -1))
        same = F.struct(state["sum"].alias("sum"), *[state[n].alias(n) for n in longs])
        return F.when(i > WINDOW, less).otherwise(same)

    def enter(state: Column, i: Column) -> Column:
        letter = F.element_at(letters, i)
        n = count(state, letter)
        return F.struct((state["sum"] + F.element_at(sums, n + 2) - F.element_at(sums, n + 1)).alias("sum"), *added(state, letter, 1))

    def step(state: Column, i: Column) -> Column:
        counted = F.transform(F.array(leave(state["now"], i)), lambda s: enter(s, i))
        return F.transform(counted, lambda now: marked(state, now, i))[0]

    def marked(state: Column, now: Column, i: Column) -> Column:
        hot = (i >= WINDOW) & (now["sum"] <= limit)
        on = state["end"] >= i - WINDOW
        closed = F.concat(state["out"], F.array(F.struct(state["start"].alias("start"), state["end"].alias("end"))))
        return F.struct(
            now.alias("now"),
            F.when(hot & ~on, i - WINDOW).otherwise(state["start"]).alias("start"),
            F.when(hot, i).otherwise(state["end"]).alias("end"),
            F.when(hot & ~on & (state["end"] >= 0), closed).otherwise(state["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("sum"), *[F.lit(0).cast("long").alias(n) for n in longs])
    begin = F.struct(zero.alias("now"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), none.alias("out"))
    last = lambda s: F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.aggregate(F.sequence(F.lit(1), F.size(letters)), begin, step, lambda s: F.when(s["end"] < 0, none).otherwise(F.concat(s["out"], last(s))))


def _cut(every: Column) -> Column:
    """What is left of hot spans where base spans are cut out, as entropy spans; `every` holds both, sorted."""

    def piece(start: Column, end: Column) -> Column:
        long = F.array(F.struct(start.alias("start"), F.lit(3).alias("kind"), end.alias("end")))
        return F.when(end - start >= LEAST_LEFT, long).otherwise(F.expr(NO_SPANS))

    def step(state: Column, s: Column) -> Column:
        base = s["kind"] < 3
        done = piece(state["start"], F.when(base, F.least(state["end"], s["start"])).otherwise(state["end"]))
        covered = F.when(base, F.greatest(state["covered"], s["end"])).otherwise(state["covered"])
        return F.struct(
            F.when(base, F.greatest(state["start"], s["end"])).otherwise(F.greatest(s["start"], state["covered"])).alias("start"),
            F.when(base, state["end"]).otherwise(s["end"]).alias("end"),
            covered.alias("covered"),
            F.when(F.size(done) > 0, F.concat(state["out"], done)).otherwise(state["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("covered"), F.expr(NO_SPANS).alias("out"))
    return F.aggregate(every, begin, step, lambda s: F.concat(s["out"], piece(s["start"], s["end"])))


def with_secrets(df: DataFrame, text: str = "text", name: str = "secrets") -> DataFrame:
    """df with the array of spans (start, kind, end), sorted; kind counts from 0 in `KINDS`."""
    whole = F.coalesce(F.col(text), F.lit(""))
    assigned = F.filter(matches(whole, ASSIGN), lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= LEAST_ASSIGN)
    found = df.withColumns(
        {
            "_base": F.array_sort(F.concat(_kind(assigned, 0), _kind(matches(whole, ACCESS), 1), _kind(matches(whole, HEX), 2))),
            "_candidates": F.filter(matches(whole, CANDIDATE), lambda m: ~m["found"].rlike(ALLOWED)),
        }
    )

    def prepared(m: Column) -> Column:
        limit = F.lit(_limit(CLASSES[-1][1]))
        for pattern, bits in reversed(CLASSES[:-1]):
            limit = F.when(m["found"].rlike(pattern), F.lit(_limit(bits))).otherwise(limit)
        letters = F.transform(F.split(m["found"], ""), lambda c: F.instr(F.lit(LETTERS), c) - 1)
        return F.struct(m["start"].alias("start"), m["found"].alias("found"), letters.alias("letters"), limit.alias("limit"))

    found = found.withColumn("_candidates", F.transform("_candidates", prepared))

    def of_candidate(m: Column) -> Column:
        def no_placeholder(x: Column) -> Column:
            span = F.substring(m["found"], x["start"] + 1, x["end"] - x["start"])
            return ~span.rlike(PLACEHOLDER) | F.exists(F.split(span, "/"), lambda part: (F.length(part) >= WINDOW) & ~part.rlike(PLACEHOLDER))

        hot = F.filter(hot_windows(m["letters"], m["limit"]), no_placeholder)
        return F.transform(hot, lambda x: F.struct((m["start"] + x["start"]).alias("start"), F.lit(3).alias("kind"), (m["start"] + x["end"]).alias("end")))

    none = F.expr(NO_SPANS)
    found = found.withColumn("_hot", F.when(F.size("_candidates") > 0, F.flatten(F.transform("_candidates", of_candidate))).otherwise(none))
    cut = F.array_sort(F.concat("_base", _cut(F.array_sort(F.concat("_base", "_hot")))))
    spans = F.when(F.size("_hot") == 0, F.col("_base")).when(F.size("_base") == 0, F.col("_hot")).otherwise(cut)
    return found.withColumn(name, spans).drop("_candidates", "_base", "_hot")


def spelled(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with every run of spans that overlap or touch replaced by the mark."""
    return splice(text, merged(spans), lambda s: F.lit(mark))


def op2(docs: DataFrame) -> DataFrame:
    found = with_secrets(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spelled(F.filter("secrets", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        spelled(F.col("secrets")).alias("spans"),
        count(3).alias("n_entropy"),
    )


def oracle() -> str:
    """The same rows for op2, with every window counted by itself and base spans cut out character by character."""
    fold = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    words = "|".join(fold(w) for w in ("password", "passwd", "secret", "token")) + "|" + fold("api") + "_?" + fold("key")
    assign = rf"""({words})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    allowed = (
        r"^[-_/=+]*(?:(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[A-Za-z][-_/=+]+)[-_/=+]*)*[A-Za-z]?$|^[-_/=+0-9]+$"
        r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    )
    limit = "case " + " ".join(f"when regexp_matches(found, '{p}') then {_limit(bits)}" for p, bits in CLASSES[:-1]) + f" else {_limit(CLASSES[-1][1])} end"
    patterns = ", ".join(f"({k}, '{p}')" for k, p in enumerate((assign, ACCESS, HEX, CANDIDATE)))
    return rf"""
with d as (select doc_id, row_number() over () as r, coalesce(text, '') as t from documents),
lists as (select r, kind, p, regexp_extract_all(t, p) as found, string_split_regex(t, p) as gaps from d, (values {patterns}) k(kind, p) where regexp_matches(t, p)),
each as (select r, kind, p, found, gaps, unnest(range(1, len(found) + 1)) as i from lists),
placed as (select r, kind, found[i] as found, i, sum(len(gaps[i]) + len(found[i])) over (partition by r, kind order by i) - len(found[i]) as start from each),
base as (select r, kind, start, start + len(found) as stop from placed where kind in (1, 2) or kind = 0 and len(regexp_extract(found, '{assign}', 2)) >= {LEAST_ASSIGN}),
c as (select r, i as c, start, found, {limit} as most from placed where kind = 3 and not regexp_matches(found, '{allowed}')),
w as (select r, c, start, found, most, unnest(range(0, len(found) - {WINDOW - 1})) as j from c),
hot as (
  select r, c, start, found, j from w
  where list_sum(list_transform(map_values(list_histogram(string_split(found[j + 1 : j + {WINDOW}], ''))), lambda n: {_SUMS}[(n + 1)::bigint])) <= most
), marked as (
  select *, case when j > lag(j) over (partition by r, c order by j) + {WINDOW} then 1 else 0 end as fresh from hot
), islands as (
  select *, sum(fresh) over (partition by r, c order by j) as island from marked
), spans as (
  select r, c, island, any_value(start) as base_at, any_value(found) as found, min(j) as a, max(j) + {WINDOW} as z from islands group by r, c, island
), real as (
  select r, c, island, base_at + a as start, base_at + z as stop from spans
  where not regexp_matches(found[a + 1 : z], '{PLACEHOLDER}')
     or len(list_filter(string_split(found[a + 1 : z], '/'), lambda x: len(x) >= {WINDOW} and not regexp_matches(x, '{PLACEHOLDER}'))) > 0
), chars as (
  select r, c, island, unnest(range(start::bigint, stop::bigint)) as x from real
), free as (
  select r, c, island, x, x - row_number() over (partition by r, c, island order by x) as run from chars
  where not exists (select 1 from base b where b.r = chars.r and x >= b.start and x < b.stop)
), entropy as (
  select r, 3 as kind, min(x) as start, max(x) + 1 as stop from free group by r, c, island, run having count(*) >= {LEAST_LEFT}
), every as (
  select r, kind, start::bigint as start, stop::bigint as stop from base union all select r, kind, start, stop from entropy
), told as (
  select r, count(*) filter (kind = 0) as n0, count(*) filter (kind = 1) as n1, count(*) filter (kind = 2) as n2, count(*) filter (kind = 3) as n3,
    string_agg({list(KINDS)}[kind + 1] || ':' || start || ':' || stop, ',' order by start, kind, stop) filter (kind < 3) as base,
    string_agg({list(KINDS)}[kind + 1] || ':' || start || ':' || stop, ',' order by start, kind, stop) as spans
  from every group by r
)
select doc_id, coalesce(n0, 0)::bigint as n_assign, coalesce(n1, 0)::bigint as n_access, coalesce(n2, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256,
       coalesce(spans, '') as spans, coalesce(n3, 0)::bigint as n_entropy
from d left join told using (r)
"""
