"""Substring dedup: repeated runs of words found in a compacted De Bruijn graph.

A window is `SPAN` consecutive words of one text. A word is removed if a window that covers it starts in
a text of smaller id as well.

Edges. The token k-mers of `SPAN` words are the edges of the graph. Consecutive ones that share their
least k-mer of `ANCHOR` words, the anchor, are compacted where the text is read: a segment stands for a
run of windows, by its anchor, a hash of its words, its place and its number of windows. Which windows
share an anchor follows from their words alone, so equal runs give equal segments. Windows whose anchor
is found in one text only can't be repeated; an aggregate and a join on anchors drop them.

Paths. An anchor with one segment has the same surroundings wherever it stands. Such segments that
always follow each other are joined into nonbranching paths, by pointer doubling: each round is a join of
the table of links with itself. All windows of a path start in the same texts, so a path needs the
smallest of its texts only. Where an anchor has several segments the paths branch; there the windows
themselves are grouped, once for each distinct segment and not for each of its places.

Sources. Every path and branching segment has source coordinates in its smallest text. A second hash of
the source's words is taken there and compared, in each text, with that of the words at hand, before
anything is removed.

Rows are dealt by anchor, segment or text, never gathered by a key alone: hot anchors are pre-aggregated,
and joins on them can be split. Null and empty texts have no words; texts of fewer than `SPAN` words have
no windows; a text without an id neither loses words nor takes them from others; rows repeated under one
id are one text for this purpose, and each keeps its row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garim.llm.shared import Texts, U, discard, saved, small_batches, strings, with_columns, xxh64

SPAN = 50
ANCHOR = 14
_STEPS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Rolling:
    """Hashes of any run of words in a sequence, by prefix sums of a polynomial."""

    def __init__(self, words: np.ndarray, step: int):
        n = len(words)
        up, back = np.full(n, U(step)), np.full(n + 1, U(pow(step, -1, 1 << 64)))
        up[:1] = back[:1] = 1
        self.back = np.multiply.accumulate(back)
        self.total = np.concatenate([np.zeros(1, U), np.cumsum(words * np.multiply.accumulate(up), dtype=U)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.total[ends] - self.total[starts]) * self.back[starts]
        h ^= h >> U(32)
        h *= U(0xD6E8FEB86659FD93)
        return h ^ (h >> U(29))


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = Texts(column)
    starts, ends, first = texts.words()
    return xxh64(texts.buf, starts, ends), first


def text_segments(words: np.ndarray, first: np.ndarray, span: int, anchor: int) -> dict[str, np.ndarray]:
    """Segments of a batch of texts: the text's index, anchor, segment hash, place and windows."""
    wide = span - anchor + 1
    counts = np.maximum(np.diff(first) - span + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    if not bounds[-1]:
        return {n: np.zeros(0, np.int64) for n in ("text", "anchor", "seg", "place", "n")}
    rolling = Rolling(words, _STEPS[0])
    at = np.arange(len(words) - anchor + 1)
    mers = rolling.of(at, at + anchor)
    starts = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], counts)
    least = starts + np.lib.stride_tricks.sliding_window_view(mers, wide)[starts].argmin(axis=1)
    cut = np.flatnonzero(np.concatenate([[True], np.diff(least) != 0]))
    n = np.diff(np.concatenate([cut, [len(least)]]))
    begin, mid = starts[cut], least[cut]
    whole = rolling.of(begin, begin + n + span - 1) ^ (n.astype(U) * U(0x9E3779B97F4A7C15)) ^ ((mid - begin).astype(U) << U(48))
    text = np.searchsorted(first, begin, side="right") - 1
    return {"text": text, "anchor": mers[mid].view(np.int64), "seg": whole.view(np.int64), "place": begin - first[text], "n": n}


def segments(docs: DataFrame, span: int, anchor: int) -> DataFrame:
    """(doc, anchor, seg, place, n) of all segments of docs (doc, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_segments(*_tokens(batch.column("text")), span, anchor)
            ids = batch.column("doc").take(pa.array(found["text"]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(found["anchor"]), pa.array(found["seg"]), pa.array(found["place"], pa.int32()), pa.array(found["n"], pa.int32())],
                names=["doc", "anchor", "seg", "place", "n"],
            )

    return docs.mapInArrow(run, "doc long, anchor long, seg long, place int, n int")


def paths(places: DataFrame, lone: DataFrame) -> DataFrame:
    """(head, n): the first segment of each nonbranching path of `lone` segments and its windows in all.

    places: (doc, id, place, n) of all repeated segments; lone: (id) of those that alone have their anchor.
    """
    order = Window.partitionBy("doc").orderBy("place")
    mine = places.join(lone, "id")
    beside = mine.select(
        "id",
        "n",
        F.when(F.lead("place").over(order) == F.col("place") + F.col("n"), F.lead("id").over(order)).alias("after"),
        F.when(F.lag("place").over(order) + F.lag("n").over(order) == F.col("place"), F.lag("id").over(order)).alias("before"),
    )
    only = lambda c: F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.min(c))
    nodes = saved(beside.groupBy("id").agg(F.min("n").alias("n"), only("after").alias("after"), only("before").alias("before")), "nodes")
    linked = nodes.alias("x").join(nodes.alias("y"), (F.col("x.before") == F.col("y.id")) & (F.col("y.after") == F.col("x.id")), "left")
    # Each segment points at one before it on its path, and knows the windows from there up to itself.
    live = saved(linked.select("x.id", F.coalesce("y.id", "x.id").alias("head"), F.col("x.n").cast("long").alias("n")), "pointers")
    while True:
        far = live.select(F.col("id").alias("head"), F.col("head").alias("further"), F.col("n").alias("more"))
        step = live.join(far, "head").select(
            "id",
            F.col("further").alias("head"),
            (F.col("n") + F.when(F.col("head") != F.col("further"), F.col("more")).otherwise(0)).alias("n"),
            (F.col("head") != F.col("further")).alias("moved"),
        )
        step = saved(step, "pointers")
        discard(live)
        live = step.drop("moved")
        if not step.where("moved").head(1):
            break
    # n counts a segment and those back to, but without, the head it points at.
    sizes = live.groupBy("head").agg(F.max(F.when(F.col("id") != F.col("head"), F.col("n"))).alias("rest"))
    out = saved(
        sizes.join(nodes.select(F.col("id").alias("head"), F.col("n").cast("long").alias("own")), "head").select(
            "head", (F.col("own") + F.coalesce("rest", F.lit(0))).cast("int").alias("n")
        ),
        "paths",
    )
    discard(live)
    discard(nodes)
    return out


def _source_hashes(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """(id, n, first, check, windows): a second hash of the source's words, and for branching segments the
    hashes of their windows. wanted: (id, first, place, n, branches)."""
    asked = wanted.groupBy(F.col("first").alias("doc")).agg(F.collect_list(F.struct("id", "place", "n", "branches")).alias("asked"))
    both = docs.join(asked, "doc")
    schema = "id struct<anchor:long,seg:long>, n int, first long, check long, windows array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = _tokens(batch.column("text"))
            one, two = Rolling(words, _STEPS[0]), Rolling(words, _STEPS[1])
            rows = []
            for base, doc, asked in zip(first.tolist(), batch.column("doc").to_pylist(), batch.column("asked").to_pylist(), strict=False):
                places = np.array([a["place"] for a in asked], np.int64) + base
                sizes = np.array([a["n"] for a in asked], np.int64)
                checks = two.of(places, places + sizes + span - 1).view(np.int64).tolist()
                for a, at, check in zip(asked, places.tolist(), checks, strict=True):
                    windows = None
                    if a["branches"]:
                        starts = np.arange(at, at + a["n"])
                        windows = one.of(starts, starts + span).view(np.int64).tolist()
                    rows.append({"id": a["id"], "n": a["n"], "first": doc, "check": check, "windows": windows})
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return both.mapInArrow(run, schema)


_ARROW = pa.schema(
    [
        ("id", pa.struct([("anchor", pa.int64()), ("seg", pa.int64())])),
        ("n", pa.int32()),
        ("first", pa.int64()),
        ("check", pa.int64()),
        ("windows", pa.list_(pa.int64())),
    ]
)


def repeated_spans(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """(doc, spans): for each text of docs (doc, text) its spans (place, n, check, mask) of windows that
    start in an earlier text too; mask tells which of the n windows, and is null for all of them."""
    docs = docs.where("doc is not null")
    every = saved(segments(docs, span, anchor), "segments")
    # Written first: a join in the aggregate's own stage could not be split where an anchor is hot.
    shared = every.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("anchor")
    shared = saved(shared, "anchors")
    places = saved(every.join(shared, "anchor").select("doc", F.struct("anchor", "seg").alias("id"), "place", "n"), "places")
    discard(every)
    discard(shared)

    known = saved(places.groupBy("id").agg(F.min(F.struct("doc", "place")).alias("source"), F.max("doc").alias("last"), F.min("n").alias("n")), "known")
    single = known.groupBy(F.col("id.anchor").alias("anchor")).agg(F.count("*").alias("kinds")).where("kinds = 1")
    single = saved(single.select("anchor"), "single")
    lone = saved(single.join(known.select("id", F.col("id.anchor").alias("anchor")), "anchor").select("id"), "lone")
    whole = paths(places, lone)

    sources = known.select("id", F.col("source.doc").alias("first"), F.col("source.place").alias("place"), "n")
    wanted = sources.drop("n").join(whole.select(F.col("head").alias("id"), "n"), "id").withColumn("branches", F.lit(False))
    branching = sources.join(lone, "id", "left_anti").withColumn("branches", F.lit(True))
    columns = ("id", "first", "place", "n", "branches")
    hashed = saved(_source_hashes(docs, wanted.select(*columns).union(branching.select(*columns)), span), "sources")

    # Of each window at a branch, the smallest text that it starts in.
    windows = hashed.where("windows is not null").select("id", "first", F.posexplode("windows").alias("i", "h"))
    least = saved(windows.groupBy(F.col("id.anchor").alias("anchor"), "h").agg(F.min("first").alias("low")), "least")
    lows = windows.withColumn("anchor", F.col("id.anchor")).join(least, ["anchor", "h"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "low"))).alias("lows"))
    ready = saved(hashed.drop("windows").join(lows, "id", "left"), "ready")

    found = places.select("doc", "id", "place").join(ready, "id")
    mask = F.expr("aggregate(lows, 0L, (m, x) -> m | if(x.low < doc, shiftleft(1L, x.i), 0L))")
    found = found.select("doc", "place", "n", "check", "first", mask.alias("mask"))
    found = found.where("case when mask is null then first < doc else mask <> 0 end")
    spans = found.groupBy("doc").agg(F.collect_list(F.struct("place", "n", "check", "mask")).alias("spans"))
    out = saved(spans, "spans")
    for old in (places, known, single, lone, whole, hashed, least, ready):
        discard(old)
    return out


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """docs with `n_words`, `n_removed` and `kept`, the words that stay, joined by one space."""
    spans = repeated_spans(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), span, anchor)
    spans = spans.select(F.col("doc").alias("_doc"), F.col("spans").alias("_spans"))
    both = docs.drop("_doc", "_spans").join(spans, F.col(key) == F.col("_doc"), "left").drop("_doc")

    def start():
        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            asked = batch.column("_spans").to_pylist()
            some = [i for i, a in enumerate(asked) if a]
            gone = dict(zip(some, _removed(batch.column(text).take(pa.array(some, pa.int64())), [asked[i] for i in some], span), strict=True))
            kept, counts, removed = [], [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                words = (t or "").encode().split()  # at the six ASCII white-space bytes
                counts.append(len(words))
                if i in gone:
                    words = [w for w, g in zip(words, gone[i].tolist(), strict=True) if not g]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words).decode())
            return [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), strings(kept)]

        return make

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    return with_columns(both, fields, start).drop("_spans")


def _removed(column: pa.Array, asked: list[list[dict]], span: int) -> Iterator[np.ndarray]:
    """For each text which of its words go; a span counts if its words have the source's hash."""
    words, first = _tokens(column)
    check = Rolling(words, _STEPS[1])
    for base, end, spans in zip(first[:-1].tolist(), first[1:].tolist(), asked, strict=True):
        edge = np.zeros(end - base + 1, np.int64)
        for s in spans:
            a, z = s["place"], s["place"] + s["n"] + span - 1
            if z > end - base or check.of(np.array([base + a]), np.array([base + z])).view(np.int64)[0] != s["check"]:
                continue
            starts = np.array([a]) if s["mask"] is None else a + np.flatnonzero([s["mask"] >> i & 1 for i in range(s["n"])])
            ends = np.array([z]) if s["mask"] is None else starts + span
            np.add.at(edge, starts, 1)
            np.add.at(edge, ends, -1)
        yield np.cumsum(edge[:-1]) > 0


def op3(docs: DataFrame) -> DataFrame:
    found = without_repeats(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows for op3 by listing every window.
ORACLE = r"""
with w as (
  select doc_id, case when regexp_matches(coalesce(text, ''), '[^ \t-\r]') then regexp_extract_all(text, '[^ \t-\r]+') else [] end as ws from documents
), p as (
  select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50
), h as (
  select doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) as h from p
), g as (
  select doc_id, i, min(doc_id) over (partition by h) as low from h
), gone as (
  select doc_id, list_distinct(flatten(list(range(i, i + 50)))) as gone from g where low < doc_id group by doc_id
), kept as (
  select w.doc_id, len(ws) as n, case when gone is null then ws else list_transform(list_filter(range(1, len(ws) + 1), lambda j: not list_contains(gone, j)), lambda j: ws[j]) end as k
  from w left join gone using (doc_id)
)
select doc_id, cast(n as bigint) as n_words, cast(n - len(k) as bigint) as n_removed, sha256(coalesce(array_to_string(k, ' '), '')) as kept_sha256 from kept
"""
