"""Near copies by word shingles: SimHash balls and MinHash bands find pairs, exact Jaccard settles them.

A text is the set of its `WORDS`-word shingles (lower case, single spaces; a shorter text is one shingle).
Operator 9 links texts whose SimHash fingerprints over these shingles lie within `simhash.RADIUS` bits. Texts of
similarity 0.8 often lie further apart than any ball can reach, so texts that agree in all `ROWS` minimums of one of
`BANDS` bands are paired as well. Two texts of similarity s do so with probability 1 - (1 - s ** ROWS) ** BANDS:
0.9996 at 0.8, more above. Every pair that is linked is checked on the texts themselves, so no link lies below the
threshold. All texts whose fingerprints hang together by such balls are one more bucket beside those of the bands.

Equal texts collapse first. Pairs are sifted by the share of `BANDS` * `ROWS` minimums, of which a byte each is kept,
on which they agree: a pair of similarity 0.8 falls below `SIFT` once in some million times. Only the texts of the
rest are compared. In a bucket of more than `SMALL` texts all texts are compared with a few centres (`CENTRES`), first of all with the
text that shares most with the others, the original of a group of edited copies. That is a bounded number of pairs for each text.
At last every bucket's texts that those links don't connect are compared: in small ones pair by pair, in large ones block by block
(`_between_blocks`). A block is some of a bucket's texts; a task counts the shingles that all texts of two blocks share, exactly and
without a row for each pair, and returns no more links than the blocks have texts, enough to connect all that are similar.
So no link of a bucket between groups is lost. The time for texts that match no centre still grows as the square of their number in
one bucket, by a product of matrices; a task's memory and rows are bounded by `BLOCK` and `BLOCK_BYTES`.

Joins with texts are told to merge: a list of wanted texts that is small enough to be broadcast is so on small inputs alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garim.llm import simhash
from garim.llm.components import connected_components
from garim.llm.shared import Texts, U, discard, saved, with_columns, xxh64

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 20, 5
SMALL = 16
#: Centres of a large bucket, by round.
CENTRES = (1, 4)
#: Texts of a block and their bytes, about.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Shingles whose texts are multiplied at once.
SLAB = 1 << 12
#: The least share of minimums that a pair worth comparing agrees on.
SIFT = 0.6
#: Shingles that are worked on at once, so that they stay in the cache.
AT_ONCE = 1 << 15

_SEEDS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), U) | U(1)


def _hashes(texts: Texts, words: int) -> tuple[Texts, np.ndarray, np.ndarray]:
    texts, starts, ends, bounds = simhash.shingle_spans(texts.lowered(), words)
    return texts, xxh64(texts.buf, starts, ends), bounds


def _bands(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of band hashes and one of bytes of minimums for each range of hashes, none of which is empty."""
    out, low = np.empty((len(bounds) - 1, BANDS), U), np.empty((len(bounds) - 1, BANDS * ROWS), np.uint8)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + AT_ONCE, side="right")) - 1)
        part, cuts = hashes[bounds[at] : bounds[to]], bounds[at:to] - bounds[at]
        for band in range(BANDS):
            mixed = np.full(to - at, U(band + 1))
            for k in range(band * ROWS, (band + 1) * ROWS):
                least = np.minimum.reduceat((part ^ _SEEDS[0, k]) * _SEEDS[1, k], cuts)
                low[at:to, k] = (least ^ (least >> U(24))).astype(np.uint8)
                mixed = (mixed ^ least) * U(0x9E3779B97F4A7C15)
                mixed ^= mixed >> U(32)
            out[at:to, band] = mixed
        at = to
    return out, low


def sketches(df: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """df with a hash of each text's words (fp, long), its SimHash (sim, long), its band hashes, and a byte of each
    minimum (sig); a text without words has fp alone."""

    def start():
        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            texts, hashes, bounds = _hashes(Texts(batch.column(text)), words)
            prints = xxh64(texts.buf, texts.offs[:-1], texts.offs[1:])
            rows = np.flatnonzero(np.diff(bounds))
            made, low = _bands(hashes, np.append(bounds[rows], bounds[-1])) if len(rows) else (np.zeros((0, BANDS), U), None)
            sigs: list[bytes | None] = [None] * texts.n
            for i, row in enumerate(rows.tolist()):
                sigs[row] = low[i].tobytes()
            offsets = np.concatenate([[0], np.cumsum(np.diff(bounds) > 0)]) * BANDS
            bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(made.ravel().view(np.int64)))
            sims = simhash.majority_bits(hashes, bounds).view(np.int64)
            return [pa.array(prints.view(np.int64)), pa.array(sims, mask=np.diff(bounds) == 0), bands, pa.array(sigs, pa.binary())]

        return make

    fields = [T.StructField("fp", T.LongType()), T.StructField("sim", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())]
    return with_columns(df, fields, start)


def _sifted(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that agree on enough minimums; a written table."""
    both = pairs.join(sigs.select(F.col("fp").alias("a"), F.col("sig").alias("left")), "a")
    both = both.join(sigs.select(F.col("fp").alias("b"), F.col("sig").alias("right")), "b")

    def start():
        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("left", "right"))
            return [pa.array((x == y).mean(axis=1) >= SIFT)]

        return make

    return saved(with_columns(both, [T.StructField("near", T.BooleanType())], start).where("near").select("a", "b"), "sifted")


def _similar(pairs: DataFrame, texts: DataFrame, least: float, words: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts' Jaccard similarity reaches `least`."""
    both = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("left")).hint("merge"), "a")
    both = both.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("right")).hint("merge"), "b")

    def start():
        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            (_, x, i), (_, y, j) = (_hashes(Texts(batch.column(c)), words) for c in ("left", "right"))
            near = []
            for k in range(batch.num_rows):
                a, b = np.unique(x[i[k] : i[k + 1]]), np.unique(y[j[k] : j[k + 1]])
                shared = len(np.intersect1d(a, b, assume_unique=True))
                near.append(shared >= least * (len(a) + len(b) - shared))
            return [pa.array(near, pa.bool_())]

        return make

    return with_columns(both, [T.StructField("near", T.BooleanType())], start).where("near").select("a", "b")


def _ordered(one: str, other: str) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _balls(distinct: DataFrame) -> DataFrame:
    """(fp, band) of all texts with a SimHash: those whose SimHashes are equal or linked, through others too, share a band."""
    sims = distinct.select("fp", "sim").where("sim is not null")
    rooted = connected_components(simhash.links(sims.select(F.col("sim").alias("fp"))))
    of = sims.join(rooted, F.col("sim") == F.col("node"), "left")
    out = saved(of.select("fp", F.xxhash64(F.lit("ball"), F.coalesce("root", "sim")).alias("band")), "balls")
    discard(rooted)
    return out


def _between_groups(grouped: DataFrame) -> DataFrame:
    """All pairs (a, b) of texts of one band and different roots, of (band, fp, root). Pairs of roots come first, so that the
    texts of one root are not held against each other."""
    roots = grouped.select("band", "root").distinct()
    apart = roots.toDF("band", "root_a").join(roots.toDF("band", "root_b"), "band").where("root_a < root_b")
    pairs = apart.join(grouped.toDF("band", "x", "root_a"), ["band", "root_a"]).join(grouped.toDF("band", "y", "root_b"), ["band", "root_b"])
    return pairs.select(*_ordered("x", "y")).distinct()


def _forest(left: np.ndarray, right: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Some of the pairs of indices, fewer than twice the labels, that connect the labels of all pairs; labels are indices too."""
    live, kept = np.arange(len(left)), [np.zeros(0, np.int64)]
    while True:
        live = live[label[left[live]] != label[right[live]]]
        if not len(live):
            return np.concatenate(kept)
        # A pair for each label that one leads from.
        _, first = np.unique(np.concatenate([label[left[live]], label[right[live]]]), return_index=True)
        chosen = live[np.unique(first % len(live))]
        kept.append(chosen)
        label = simhash._stars(label, label[left[chosen]], label[right[chosen]])[label]


def _alike(texts: pa.Array, root: np.ndarray, one: np.ndarray, other: np.ndarray, least: float, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices of texts, from `one` and `other`, that reach `least`: enough to connect all roots that such pairs do."""
    _, hashes, bounds = _hashes(Texts(texts), words)
    rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((rows, hashes))
    hashes, rows = hashes[order], rows[order]
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    hashes, rows = hashes[~again], rows[~again]
    size = np.bincount(rows, minlength=len(texts))
    _, column, count = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = count[column] > 1  # others are in one text alone
    rows, column = rows[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    common = np.zeros((len(one), len(other)), np.float32)
    cuts = np.searchsorted(column, np.arange(0, column[-1] + SLAB + 1, SLAB)) if len(column) else []
    for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        held = np.zeros((len(texts), SLAB), np.float32)
        held[rows[a:z], column[a:z] - k * SLAB] = 1
        common += held[one] @ held[other].T
    near = common >= least * (size[one][:, None] + size[other] - common)
    left, right = np.nonzero(near & (root[one][:, None] != root[other]))
    left, right = one[left], other[right]
    _, label = np.unique(root, return_inverse=True)
    kept = _forest(left, right, label)
    return left[kept], right[kept]


def _between_blocks(grouped: DataFrame, texts: DataFrame, least: float, words: int) -> DataFrame:
    """Links (a, b) between texts of one band and different roots, of (band, fp, root), enough to connect all roots that similar texts do.
    A root with many texts in a band has blocks of its own, which are not held against each other; other roots share blocks."""
    sized = grouped.join(texts.select("fp", F.octet_length("text").alias("bytes")), "fp")
    roots = sized.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    own = (F.col("n") >= BLOCK // 2) | (F.col("bytes") >= BLOCK_BYTES // 2)
    roots = saved(roots.withColumn("of", F.when(own, F.col("root").cast("string")).otherwise("")), "roots")
    count = F.ceil(F.greatest(F.sum("n") / BLOCK, F.sum("bytes") / BLOCK_BYTES, F.lit(1)))
    parts = saved(roots.groupBy("band", "of").agg(count.alias("parts"), F.count("*").alias("roots")), "parts")
    block = F.concat_ws("/", "of", "part").alias("block")
    blocks = parts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("band", "of", "roots", block)
    other = blocks.select("band", F.col("of").alias("of_b"), F.col("block").alias("second"))
    pairs = blocks.withColumnRenamed("block", "first").join(other, "band").where("first <= second and (of <> of_b or of = '' and roots > 1)")
    ends = F.array_distinct(F.array("first", "second"))
    pairs = saved(pairs.select("band", "first", "second", F.explode(ends).alias("block")), "blocks")

    part = F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part")
    dealt = grouped.join(roots.select("band", "root", "of"), ["band", "root"]).join(parts.select("band", "of", "parts"), ["band", "of"])
    dealt = saved(dealt.select("band", "fp", "root", "of", part).select("band", "fp", "root", block).join(pairs, ["band", "block"]), "dealt")

    def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        fps, root = (group.column(c).to_numpy() for c in ("fp", "root"))
        at = np.array(group.column("block").to_pylist())
        one, other = (np.flatnonzero(at == key[k].as_py()) for k in (1, 2))
        text = pa.concat_arrays([c.cast(pa.large_string()) for c in group.column("text").chunks])
        left, right = _alike(text, root, one, other, least, words)
        return pa.table({"a": np.minimum(fps[left], fps[right]), "b": np.maximum(fps[left], fps[right])})

    both = dealt.join(texts.select("fp", "text").hint("merge"), "fp")
    out = saved(both.groupBy("band", "first", "second").applyInArrow(compare, "a long, b long").distinct(), "similar")
    for gone in (roots, parts, pairs, dealt):
        discard(gone)
    return out


def _texts(prints: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, text), once for each fingerprint that is wanted; a written table."""
    return saved(prints.select("fp", "text").join(wanted.toDF("fp").distinct().hint("merge"), "fp", "left_semi").dropDuplicates(["fp"]), "texts")


def links(prints: DataFrame, least: float = LEAST, words: int = WORDS) -> DataFrame:
    """Links (a, b) between the distinct values of `fp` of (fp, text, sim, bands, sig), each of at least this similarity."""
    distinct = saved(prints.select("fp", "sim", "bands", "sig").dropDuplicates(["fp"]), "distinct")
    balls, sigs = _balls(distinct), distinct.select("fp", "sig").where("sig is not null")
    members = distinct.select("fp", F.explode("bands").alias("band")).union(balls)
    # Written first, so that joins with large buckets can be split.
    buckets = saved(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = saved(members.join(buckets, "band"), "shared")
    small, big = shared.where(F.col("n") <= SMALL), shared.where(F.col("n") > SMALL).select("band", "fp")
    # The original of a group of edited copies is in the largest buckets, and in most of them.
    weights = shared.where(F.col("n") > SMALL).groupBy("fp").agg(F.sum("n").alias("weight"))
    weights = saved(weights, "weights")

    texts = _texts(prints, big.select("fp"))
    found = [prints.sparkSession.createDataFrame([], "a long, b long")]
    old = [distinct, balls, buckets, weights]

    live = saved(big.join(weights, "fp"), "live")
    old.append(live)
    for many in CENTRES:
        nth = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("weight"), "fp"))
        centres = saved(live.withColumn("nth", nth).where(F.col("nth") <= many).select("band", F.col("fp").alias("centre")), "centres")
        tried = saved(big.join(centres, "band").where("fp <> centre").select("band", "fp", *_ordered("fp", "centre")), "tried")
        pairs = _sifted(tried.select("a", "b").distinct(), sigs)
        near = saved(_similar(pairs, texts, least, words), "similar")
        hit = tried.join(near, ["a", "b"]).select("band", "fp").union(centres).distinct()
        live = saved(live.join(hit, ["band", "fp"], "left_anti"), "live")
        old += [centres, tried, pairs, live]
        found.append(near)

    # Other pairs come last: those that links connect already need no comparison.
    joined = found[0]
    for near in found[1:]:
        joined = joined.union(near)
    rooted = saved(connected_components(joined.distinct()), "rooted")

    def grouped(members: DataFrame) -> DataFrame:
        named = members.select("band", "fp").join(rooted, F.col("fp") == F.col("node"), "left")
        return saved(named.select("band", "fp", F.coalesce("root", "fp").alias("root")), "grouped")

    few, many = grouped(small), grouped(big)
    pairs = _sifted(_between_groups(few), sigs)
    last = _texts(prints, pairs.select("a").union(pairs.select("b")))
    found += [saved(_similar(pairs, last, least, words), "similar"), _between_blocks(many, texts, least, words)]
    old += [rooted, few, many, pairs, last]

    out = found[0]
    for near in found[1:]:
        out = out.union(near)
    out = saved(out.distinct(), "near")
    for gone in (*old, shared, texts, *found):
        discard(gone)
    return out


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """docs without all but one row of each group that links connect: that of the smallest key stays. Rows
    repeated under one key count as one document; a row without a key stays. Texts without words are equal."""
    prints = saved(sketches(docs.select(key, F.col(text).alias("text"))), "sketches")
    near = links(prints, least)
    named = simhash.components(prints, key, linked=near)
    rest = prints.join(named, "fp").where(F.col(key) != F.col("component_id")).select(key)
    return docs.join(rest, key, "left_anti")
