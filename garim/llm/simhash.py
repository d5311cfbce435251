"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most r bits apart share a variant that lies within r / 2 bits of both. Every
distinct fingerprint therefore emits all its variants within r / 2 bits, and those that meet at one
variant are linked. Copies collapse to one fingerprint before that, so they cost nothing.

The variants of one fingerprint number 2081 (r = 4). What is shuffled is not each of them but one row
for each bucket, that is the leading bits of a variant: 1 + b + b (b - 1) / 2 rows for b bits. The rest
of a variant's bits are flipped where the bucket is grouped, so the shuffle is some fifty times smaller
and still every variant meets every equal one. b grows with the count of fingerprints.
All fingerprints that meet at a variant are within r of each other, so a bucket returns a star for each
of its groups in place of all its pairs.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garim.llm.components import connected_components
from garim.llm.shared import Texts, U, discard, saved, small_batches, with_columns, xxh64

BITS = 64
WORDS = 4
RADIUS = 4
SEED = 42
#: Variants that one bucket is meant to hold, and those that a task sorts at once.
BUCKET = 1 << 21
AT_ONCE = 1 << 22


def shingle_spans(texts: Texts, words: int) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """Single-spaced texts, byte spans of their shingles, and each text's first shingle (n + 1)."""
    texts = texts.single_spaced()
    starts, ends, first = texts.words()
    counts = np.diff(first)
    shingles = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], shingles)
    last = np.minimum(at + words, np.repeat(first[1:], shingles)) - 1
    return texts, starts[at], ends[last], bounds


def majority_bits(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each range of hashes the word whose bits are those set in over half of them."""
    counts = np.diff(bounds)
    out = np.zeros(len(counts), U)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return out
    # Eight bits at a time are counted in the eight bytes of a word, over at most 255 hashes.
    pieces = -(-counts[rows] // 255)
    first = np.concatenate([[0], np.cumsum(pieces)])
    nth = np.arange(first[-1]) - np.repeat(first[:-1], pieces)
    cuts = np.repeat(bounds[:-1][rows], pieces) + 255 * nth
    for k in range(8):
        lanes = np.add.reduceat((hashes >> U(k)) & U(0x0101010101010101), cuts)
        by_bit = np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(by_bit, first[:-1], axis=0)
        over = (2 * total > counts[rows, None]).astype(U)
        for j in range(8):
            out[rows] |= over[:, j] << U(8 * j + k)
    return out


def fingerprints(df: DataFrame, text: str = "text", name: str = "fp", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """df with a SimHash (long) of each text's word shingles; no words give zero."""

    def start():
        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            texts, a, z, bounds = shingle_spans(Texts(batch.column(text)).lowered(), words)
            return [pa.array(majority_bits(xxh64(texts.buf, a, z, seed), bounds).view(np.int64))]

        return make

    return with_columns(df, [T.StructField(name, T.LongType())], start)


def masks(bits: range, most: int) -> list[int]:
    """All masks with up to `most` of these bits set, fewest first."""
    return [sum(1 << b for b in c) for k in range(most + 1) for c in itertools.combinations(bits, k)]


def _meet(prints: np.ndarray, prefix: int, b: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices of prints that share a variant with these b leading bits; chains, not all pairs."""
    apart = np.bitwise_count((prints >> U(BITS - b)) ^ U(prefix)) if b else np.zeros(len(prints), np.uint8)
    live = np.flatnonzero(apart <= half)
    low = [masks(range(BITS - b), k) for k in range(half + 1)]
    if sum(len(low[half - k]) * int((apart == k).sum()) for k in range(half + 1)) > AT_ONCE and b < BITS and len(live) > 1:
        parts = [_meet(prints[live], prefix << 1 | bit, b + 1, half) for bit in (0, 1)]
        return tuple(live[np.concatenate(x)] for x in zip(*parts, strict=True))
    if len(live) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = U(0) if not b else U(prefix << (BITS - b))
    rest = prints & (U((1 << (BITS - b)) - 1) if b else ~U(0))
    variants, owner = [], []
    for k in range(half + 1):
        rows = np.flatnonzero(apart == k)
        flips = np.array(low[half - k], U)
        variants.append(((rest[rows, None] ^ flips) | top).ravel())
        owner.append(np.repeat(rows, len(flips)))
    variants, owner = np.concatenate(variants), np.concatenate(owner)
    order = np.argsort(variants)
    variants, owner = variants[order], owner[order]
    same = np.flatnonzero(variants[1:] == variants[:-1])
    return owner[same], owner[same + 1]


def _stars(prints: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each print the least index that its pairs lead to."""
    root = np.arange(len(prints))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the distinct values of `fp`: enough of those within `radius` bits of each
    other that any two such values are connected."""
    half = (radius + 1) // 2
    prints = prints.select("fp").where("fp is not null").distinct()
    count = prints.count()
    each = sum(math.comb(BITS, k) for k in range(half + 1))
    b = min(40, max(0, math.ceil(math.log2(max(1, count * each / BUCKET)))))
    flips = F.array(*[F.lit(m).cast("long") for m in masks(range(b), half)])
    bucket = F.shiftrightunsigned("fp", BITS - b) if b else F.lit(0).cast("long")
    dealt = prints.select("fp", F.explode(flips).alias("flip"), bucket.alias("own")).select(
        F.col("own").bitwiseXOR(F.col("flip")).alias("bucket"), "fp"
    )
    small_batches(prints.sparkSession)

    def meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        values = np.unique(group.column("fp").to_numpy().view(U))
        left, right = _meet(values, int(key[0].as_py()), b, half)
        near = np.bitwise_count(values[left] ^ values[right]) <= radius
        pairs = np.unique(left[near] * len(values) + right[near])
        root = _stars(values, pairs // max(1, len(values)), pairs % max(1, len(values)))
        moved = np.flatnonzero(root != np.arange(len(values)))
        return pa.table({"a": values[root[moved]].view(np.int64), "b": values[moved].view(np.int64)})

    return dealt.groupBy("bucket").applyInArrow(meet, "a long, b long")


def components(prints: DataFrame, key: str = "doc_id", radius: int = RADIUS, linked: DataFrame | None = None) -> DataFrame:
    """(fp, component_id): for every distinct fingerprint the smallest key reachable by links, or by those given."""
    firsts = saved(prints.groupBy("fp").agg(F.min(key).alias("first")), "firsts")
    found = connected_components(links(firsts, radius) if linked is None else linked)
    rooted = firsts.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    rooted = saved(rooted, "rooted")
    # Written first: a join in the aggregate's own stage could not be split where a component is large.
    least = saved(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    out = saved(rooted.join(least, "root").select("fp", "component_id"), "components")
    for old in (firsts, found, rooted, least):
        discard(old)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id) of each row. Nulls and empty texts have fingerprint zero and
    link like any other; repeated rows keep one row each; an empty table gives an empty result. A
    null key keeps its row and never names a component unless no other key is there."""
    prints = saved(fingerprints(docs.select(key, text), text).select(key, "fp"), "prints")
    named = components(prints, key, radius)
    return prints.join(named, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one row of each near-duplicate group: that of the smallest key stays. Rows
    repeated under one key count as one document; a row without a key stays."""
    rest = near_duplicates(docs, key, text).where(F.col(key) != F.col("component_id")).select(key)
    return docs.join(rest, key, "left_anti")
