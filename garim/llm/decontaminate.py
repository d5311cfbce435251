"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are lower-cased and split at every ASCII character that is no letter or
digit. Runs of `SEED` shared words are the seeds that pair a text with an item; for an item of fewer words
that is all of it. For each such pair the longest unmarked common runs are marked again and again, found by
running Karp-Rabin, until none of at least a seed's size is left; marked runs never overlap. An item leaks
if its marked words make up at least `COVERAGE` of it, in whatever order its parts stand in the text.

The benchmark's seeds are broadcast while the table holds no more than `ITEMS` items and `BYTES` bytes,
which is checked; a larger one meets the texts in a shuffled join on seeds, with the same rows. Null and empty
texts and items match nothing. A repeated item row counts once, different texts under one id count each; an
item without an id is left out. Rows repeated under one doc_id, and those without one, are texts like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garim.llm.shared import Texts, U, discard, saved, small_batches, with_columns, xxh64

SEED = 5
COVERAGE = 0.5
#: Bounds on a benchmark that is broadcast.
ITEMS = 50_000
BYTES = 32 << 20
#: Candidates that a text of the joined path is tiled with at once, about.
TOGETHER = 500

_BETWEEN = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
OVERLAPS = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_covered", T.LongType()),
            T.StructField("n_tiles", T.LongType()),
        ]
    )
)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column of texts, and each text's first word (n + 1 of them)."""
    texts = Texts(pc.utf8_lower(column))
    starts, ends, first = texts.words(_BETWEEN)
    return xxh64(texts.buf, starts, ends) | U(1), first  # never zero, which fills gaps


class Windows:
    """Karp-Rabin hashes of the windows of any size over one sequence of words."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        step, back = np.full(n, U(_STEP)), np.full(n, U(_BACK))
        step[:1] = back[:1] = 1
        self.back = np.multiply.accumulate(back)
        self.total = np.concatenate([np.zeros(1, U), np.cumsum(words * np.multiply.accumulate(step), dtype=U)])

    def of(self, size: int) -> np.ndarray:
        return (self.total[size:] - self.total[:-size]) * self.back[: len(self.total) - size] if size < len(self.total) else np.zeros(0, U)


def _unmarked(marks: np.ndarray, size: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[size:] == total[:-size]


def tile(text: np.ndarray, item: np.ndarray, least: int = SEED) -> tuple[int, int]:
    """How many words of the item the tiling covers, and its number of tiles."""
    used, covered = text == 0, np.zeros(len(item), bool)
    in_text, in_item = Windows(text), Windows(item)
    size, tiles = len(item), 0
    while size >= least:
        here, there = in_text.of(size), in_item.of(size)
        open_here, open_there = _unmarked(used, size), _unmarked(covered, size)
        at: dict[int, list[int]] = {}
        for q in np.flatnonzero(open_there).tolist():
            at.setdefault(int(there[q]), []).append(q)
        hits = np.flatnonzero(open_here & np.isin(here, there[open_there]))
        found = []
        for p in hits.tolist():
            for q in at.get(int(here[p]), ()):
                if p and q and not used[p - 1] and not covered[q - 1] and text[p - 1] == item[q - 1]:
                    continue  # part of a match that starts further left
                if (text[p : p + size] != item[q : q + size]).any():
                    continue
                k = size
                while p + k < len(text) and q + k < len(item) and text[p + k] == item[q + k] and not used[p + k] and not covered[q + k]:
                    k += 1
                found.append((-k, p, q))
        marked = False
        for k, p, q in sorted(found):
            if not used[p : p - k].any() and not covered[q : q - k].any():
                used[p : p - k] = covered[q : q - k] = True
                tiles, marked = tiles + 1, True
        if not marked or not found:  # what overlapped a longer match is looked at again before going on
            size = size // 2 if size >= 2 * least else (least if size > least else 0)
    return int(covered.sum()), tiles


def _near(text: np.ndarray, seeds: np.ndarray, reach: int) -> np.ndarray:
    """The parts of a text within reach of a seed, with a gap between parts."""
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, np.maximum(seeds - reach, 0), 1)
    np.add.at(edge, np.minimum(seeds + reach, len(text)), -1)
    inside = np.cumsum(edge[:-1]) > 0
    out = np.where(inside, text, U(0))
    keep = inside | np.concatenate([[False], inside[:-1]])
    return out[keep]


def seed_size(n_words: int) -> int:
    return min(SEED, n_words)


def seeds(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; those of different sizes never meet."""
    return Windows(words).of(size) ^ U(SEED - size)


class Items:
    """Benchmark items as word hashes with a sorted index of their seeds for each size of seed."""

    def __init__(self, ids: list[int], column: pa.Array):
        words, first = tokens(column)
        self.ids = ids
        self.words = [words[a:z] for a, z in zip(first[:-1], first[1:], strict=True)]
        self.index: list[tuple[int, np.ndarray, np.ndarray]] = []
        for size in range(1, SEED + 1):
            mine = [i for i, w in enumerate(self.words) if len(w) and seed_size(len(w)) == size]
            if mine:
                found = [seeds(self.words[i], size) for i in mine]
                owner, flat = np.repeat(mine, [len(s) for s in found]), np.concatenate(found)
                order = np.argsort(flat, kind="stable")
                self.index.append((size, flat[order], owner[order]))

    def overlaps(self, column: pa.Array, least: float = 0.0) -> list[list[dict]]:
        """For each text the items that share a seed with it and of which at least this share is covered."""
        words, first = tokens(column)
        pairs: list[dict[int, list[int]]] = [{} for _ in range(len(column))]
        for size, known, owner in self.index:
            every = seeds(words, size)
            if not len(every):
                continue
            slot = np.searchsorted(known, every)
            ends = np.repeat(first[1:], np.diff(first))[: len(every)]
            at = np.flatnonzero((known[np.minimum(slot, len(known) - 1)] == every) & (np.arange(len(every)) + size <= ends))
            text_of = np.searchsorted(first, at, side="right") - 1
            last = np.searchsorted(known, every[at], side="right")
            for t, p, a, z in zip(text_of.tolist(), (at - first[text_of]).tolist(), slot[at].tolist(), last.tolist(), strict=True):
                for i in owner[a:z].tolist():
                    pairs[t].setdefault(i, []).append(p)
        out: list[list[dict]] = []
        for t, mine in enumerate(pairs):
            text = words[first[t] : first[t + 1]]
            found = (self._pair(text, i, np.array(p)) for i, p in mine.items())
            out.append(sorted((o for o in found if o["n_covered"] >= least * o["n_tokens"]), key=lambda o: tuple(o.values())))
        return out

    def _pair(self, text: np.ndarray, i: int, at: np.ndarray) -> dict:
        item = self.words[i]
        covered, tiles = tile(_near(text, at, len(item)), item, seed_size(len(item)))
        return {"item_id": self.ids[i], "n_tokens": len(item), "n_covered": covered, "n_tiles": tiles}


def overlaps(docs: DataFrame, items: DataFrame, text: str = "text", name: str = "overlaps", least: float = 0.0,
             most_items: int = ITEMS, most_bytes: int = BYTES) -> DataFrame:
    """docs with the tilings of all benchmark items (item_id, text) that share a seed with the text and of
    which at least the share `least` is covered."""
    items = items.select("item_id", "text").where("item_id is not null and text is not null").dropDuplicates(["item_id", "text"])
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if count > most_items or size > most_bytes:
        return _overlaps_by_join(docs, items, text, name, least)
    rows = items.orderBy("item_id", "text").collect()
    index = docs.sparkSession.sparkContext.broadcast(Items([r.item_id for r in rows], pa.array([r.text for r in rows], pa.string())))

    def start():
        found = index.value
        return lambda batch: [pa.array(found.overlaps(batch.column(text), least), pa.list_(_STRUCT))]

    return with_columns(docs, [T.StructField(name, OVERLAPS)], start)


_STRUCT = pa.struct([(n, pa.int64()) for n in ("item_id", "n_tokens", "n_covered", "n_tiles")])


def _item_seeds(items: DataFrame) -> DataFrame:
    """items with the number of words `_n` and the seeds, one for each place."""

    def start():
        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            words, first = tokens(batch.column("_item"))
            parts = [words[a:z] for a, z in zip(first[:-1], first[1:], strict=True)]
            found = [seeds(w, seed_size(len(w))).view(np.int64) if len(w) else [] for w in parts]
            return [pa.array([len(w) for w in parts], pa.int32()), pa.array(found, pa.list_(pa.int64()))]

        return make

    return with_columns(items, [T.StructField("_n", T.IntegerType()), T.StructField("_seeds", T.ArrayType(T.LongType()))], start)


def _text_seeds(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """texts with the distinct seeds of these sizes."""

    def start():
        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            words, first = tokens(batch.column("_text"))
            parts = [words[a:z] for a, z in zip(first[:-1], first[1:], strict=True)]
            found = [np.unique(np.concatenate([seeds(w, s) for s in sizes])).view(np.int64) for w in parts]
            return [pa.array(found, pa.list_(pa.int64()))]

        return make

    return with_columns(texts, [T.StructField("_seeds", T.ArrayType(T.LongType()))], start)


def _overlaps_by_join(docs: DataFrame, items: DataFrame, text: str, name: str, least: float) -> DataFrame:
    """As `overlaps`, for a benchmark of any size: every step is a shuffled join. Texts are told apart by
    their hash alone, so keys may be null or repeated.

    A tile of k words or more holds at least a k-th of its length in shared places of seeds, so a text that covers
    the share `least` of an item shares at least t = least * words / k of its P places: one of the P - t + 1
    rarest is among them, and the others, where the seeds that everything shares are, need not be joined.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.sha2(F.col(text), 256).alias("_key"), F.col(text).alias("_text")).where("_key is not null").dropDuplicates(["_key"])
    known = items.select("item_id", F.sha2("text", 256).alias("_item_key"), F.col("text").alias("_item"))
    seeded = saved(_item_seeds(known.dropDuplicates(["_item_key"]).drop("item_id")).where("_n > 0").select("_item_key", "_n", F.explode("_seeds").alias("seed")), "item-seeds")
    sizes = [r.size for r in seeded.select(F.least("_n", F.lit(SEED)).alias("size")).distinct().collect()]  # at most SEED of them
    distinct = saved(seeded.select("seed").distinct(), "seeds")
    of_docs = _text_seeds(texts, sizes).select("_key", F.explode("_seeds").alias("seed")) if sizes else texts.select("_key", F.lit(0).cast("long").alias("seed"))
    shared = saved(of_docs.join(distinct, "seed"), "shared-seeds")
    # Written first: joins in the aggregates' own stages could not be split where a seed is hot.
    weight = saved(shared.groupBy("seed").agg(F.count("*").alias("_texts")), "weights")
    size = F.least("_n", F.lit(SEED))
    needed = F.greatest(F.ceil(F.lit(least) * F.col("_n") / size), F.lit(1))
    nth = F.row_number().over(Window.partitionBy("_item_key").orderBy("_texts", "seed"))
    rare = seeded.join(weight, "seed", "left").withColumn("_texts", F.coalesce("_texts", F.lit(0))).withColumn("_nth", nth)
    rare = saved(rare.where(F.col("_nth") <= F.col("_n") - size + 2 - needed).where("_texts > 0").select("_item_key", "seed").distinct(), "rare")
    pairs = saved(shared.join(rare, "seed").select("_key", "_item_key").distinct(), "candidates")
    # The items of a text come in groups, so that its text is sent once for many of them.
    many = saved(pairs.groupBy("_key").agg(F.count("*").alias("_many")), "many")
    dealt = pairs.join(many, "_key").withColumn("_part", F.pmod(F.xxhash64("_item_key"), F.ceil(F.col("_many") / TOGETHER))).drop("_many")
    grouped = dealt.join(known, "_item_key").groupBy("_key", "_part").agg(F.collect_list(F.struct("item_id", "_item")).alias("_items"))
    both = grouped.join(texts, "_key").drop("_part")

    def start():
        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for t, asked in zip(batch.column("_text"), batch.column("_items").to_pylist(), strict=True):
                index = Items([a["item_id"] for a in asked], pa.array([a["_item"] for a in asked], pa.string()))
                out.append(index.overlaps(pa.array([t.as_py()], pa.string()), least)[0])
            return [pa.array(out, pa.list_(_STRUCT))]

        return make

    tiled = with_columns(both, [T.StructField("_tiled", OVERLAPS)], start).select("_key", "_tiled")
    lists = saved(tiled.groupBy("_key").agg(F.array_sort(F.flatten(F.collect_list("_tiled"))).alias(name)), "overlaps")
    out = docs.drop(name).withColumn("_text_key", F.sha2(F.col(text), 256)).join(lists, F.col("_text_key") == F.col("_key"), "left").drop("_key", "_text_key")
    for old in (seeded, distinct, shared, weight, rare, pairs, many):
        discard(old)
    return out.withColumn(name, F.coalesce(name, F.array().cast(OVERLAPS)))


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_tokens, n_covered, n_tiles, coverage) of every item that leaks into a text."""
    found = overlaps(docs.select("doc_id", "text"), items, least=coverage).select("doc_id", F.inline("overlaps"))
    return found.withColumn("coverage", F.col("n_covered") / F.col("n_tokens"))


def without_leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs whose text no item leaks into."""
    return overlaps(docs, items, name="_overlaps", least=coverage).where(F.size("_overlaps") == 0).drop("_overlaps")
