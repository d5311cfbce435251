"""Alignment of two tokenizers over a corpus: which tokens of one stand for which tokens of the other.

Both encode the same bytes, so the ends of their tokens cut these into elementary intervals: the union of both arrays
of ends. Each interval lies in one token of either side, its owner, found by binary search, and is one overlap. Where an
interval ends both its owners, a group closes. Within a group every token of one side is linked to every one of the other;
group products are expanded to count id pairs, over ids with their multiplicities where a group is large.

An id pair's count is the number of documents that hold it linked. A task takes its documents in blocks of `BLOCK_BYTES`
of text and gives each block's distinct pairs once, with the number of the block's documents that hold them, so that what
is shuffled and joined are pairs of blocks, not of documents: a pair however common is one row a block. Documents
keep their pairs as places in the block's list. The counts are summed, joined to the blocks' lists and brought back to
the block's documents.

The libraries are asked once for each distinct stretch of text. Texts are cut before each space that follows another
character than white space: there a new piece begins for the byte-level vocabulary's pattern, and no piece of the
other vocabulary holds a space after another character (that is checked when the vocabulary is read).

A text that is null or empty, or that either side's tokens don't spell byte for byte after a space, has no
tokens: zeros and an empty string. Repeated rows and rows without an id are documents of their own; an empty table gives no
rows. Only the two columns named are read. A very long text is a block by itself.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garim.llm.chunks import Remembered, flat, gathered, taken
from garim.llm.shared import Texts, discard, saved, small_batches

BLOCK_BYTES = 8 << 20
#: Bytes of text that are aligned at once.
AT_ONCE = 3 << 19
#: Stretches that are remembered at once.
REMEMBERED = 200_000
#: Products of groups are expanded token by token up to this size, and over distinct ids beyond it.
SMALL_GROUP = 64
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, block long, codes array<int>, times array<long>, pairs array<long>, held array<int>"
NAMES = [f.split()[0] for f in ALIGNED.split(", ")]
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True


# --- tokens of stretches of text -----------------------------------------------------------------


def _byte_level() -> dict[str, int]:
    """Letters of byte-level vocabularies, each of which stands for a byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {chr(b) if b in shown else chr(next(hidden)): b for b in range(256)}


class Pair:
    """Two vocabularies: for a stretch of text that begins with a space, ids and byte lengths of both."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = _byte_level()
        self.a_bytes = {i: bytes(map(letters.__getitem__, token)) for token, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in letters for c in token)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces with a space after another character: texts can't be cut at spaces")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int32)
        self.a_sizes[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int32)
        self.tokens = Remembered(self._ask, REMEMBERED)

    def _ask(self, stretches: list[str]) -> list[tuple[bytes, bytes, tuple[bytes, bytes] | None]]:
        """Ids of both sides, and what they spell where that isn't the stretch."""
        left = [x.ids for x in self.a.encode_batch_fast(stretches, add_special_tokens=False)]
        right = self.b.encode([s[1:] for s in stretches], num_threads=1)
        # ASCII of the right length is spelled as it stands: normalisers leave it alone but for white space that they drop.
        lengths = np.array([len(s) if s.isascii() else -1 for s in stretches])
        (a, a_right), (b, b_right) = (_packed(ids, sizes, lengths) for ids, sizes in ((left, self.a_sizes), (right, self.b_sizes)))
        wrong: list[tuple[bytes, bytes] | None] = [None] * len(stretches)
        for i in np.flatnonzero(~(a_right & b_right)):
            spelled = b"".join(map(self.a_bytes.__getitem__, left[i])), b"".join(map(self.b_bytes.__getitem__, right[i]))
            wrong[i] = None if spelled[0] == spelled[1] == stretches[i].encode() else spelled
        return list(zip(a, b, wrong, strict=True))


def _packed(ids: list[list[int]], sizes: np.ndarray, lengths: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The bytes of each list as 32-bit integers, and whether its tokens come to the length."""
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
    every = np.fromiter(itertools.chain.from_iterable(ids), np.int32, bounds[-1])
    told = np.concatenate([[0], np.cumsum(sizes[every], dtype=np.int64)])[bounds]
    data, cuts = every.tobytes(), (4 * bounds).tolist()
    return [data[x:y] for x, y in itertools.pairwise(cuts)], np.diff(told) == lengths


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def stretches(texts: Texts) -> tuple[pa.Array, np.ndarray]:
    """Stretches of all texts, each text after a space, and the first stretch of each text (n + 1)."""
    data = np.insert(texts.buf, texts.offs[:-1], 32)
    offs = texts.offs + np.arange(texts.n + 1)
    at = np.flatnonzero(data == 32)
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & (two == 0x9A) & (one == 0x80)
    wide |= (three == 0xE2) & ((two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF)) | (two == 0x81) & (one == 0x9F))
    wide |= (three == 0xE3) & (two == 0x80) & (one == 0x80)
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    cuts = at[edge[at] | ~_BLANK[one] & ~wide & ~edge[at + 1]]  # a last space alone would be an empty text to encode
    bounds = np.append(cuts, len(data)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return found, np.searchsorted(cuts, offs)


# --- elementary intervals ------------------------------------------------------------------------


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each elementary interval the token of either side that it lies in, and whether it ends both."""
    ends = np.union1d(a_ends, b_ends)
    a, b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return a, b, (a_ends[a] == ends) & (b_ends[b] == ends)


def _distinct(ids: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each group, how often each is there, and the groups' bounds (n + 1)."""
    keys, times = np.unique(group.astype(np.int64) << 32 | ids, return_counts=True)
    return keys & 0xFFFFFFFF, times, np.searchsorted(keys >> 32, np.arange(groups + 1))


def products(a: np.ndarray, a_bounds: np.ndarray, b: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id pair, times) of all pairs within groups: ids of `a` in the upper, of `b` in the lower 32 bits."""
    left, right = np.diff(a_bounds), np.diff(b_bounds)
    out = []
    for large in (False, True):
        rows = np.flatnonzero((left * right > SMALL_GROUP) == large)
        if not len(rows):
            continue
        x, x_bounds = taken(a, a_bounds, rows)
        y, y_bounds = taken(b, b_bounds, rows)
        if large:
            x, x_times, x_bounds = _distinct(x, np.repeat(np.arange(len(rows)), np.diff(x_bounds)), len(rows))
            y, y_times, y_bounds = _distinct(y, np.repeat(np.arange(len(rows)), np.diff(y_bounds)), len(rows))
        # Each left token meets all right tokens of its group.
        wide = np.repeat(np.diff(y_bounds), np.diff(x_bounds))
        i = np.repeat(np.arange(len(x)), wide)
        j = np.arange(len(i)) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat(np.repeat(y_bounds[:-1], np.diff(x_bounds)), wide)
        times = x_times[i] * y_times[j] if large else np.ones(len(i), np.int64)
        group = np.repeat(np.repeat(rows, np.diff(x_bounds)), wide)
        out.append((group, x[i].astype(np.int64) << 32 | y[j].astype(np.int64), times))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def _spelled(a: np.ndarray, a_bounds: np.ndarray, b: np.ndarray, b_bounds: np.ndarray, of_text: np.ndarray) -> pa.Array:
    """a1,a2|b1;a3|b2,b3 for each text, whose groups lie between the bounds `of_text`."""

    def side(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        named = pa.array(ids).cast(pa.string())
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), named), ",")

    groups = pc.binary_join_element_wise(side(a, a_bounds), side(b, b_bounds), "|").cast(pa.large_string())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), groups), pa.scalar(";", pa.large_string())).cast(pa.string())


def align_texts(column: pa.Array, both: Pair) -> tuple[dict[str, pa.Array], np.ndarray, np.ndarray, np.ndarray]:
    """Counts and groups of some texts, and each text's distinct id pairs, how often they are linked, and their bounds (n + 1)."""
    texts = Texts(column)
    found, first = stretches(texts)
    coded = found.dictionary_encode()
    tokens = both.tokens(coded.dictionary.to_pylist())
    which = coded.indices.to_numpy()
    live = np.diff(texts.offs) > 0
    wrong = np.array([t[2] is not None for t in tokens], bool)[which]
    for row in np.unique(np.searchsorted(first, np.flatnonzero(wrong), side="right") - 1):
        own = which[first[row] : first[row + 1]]
        whole = found[first[row] : first[row + 1]].to_pylist()
        spelled = [b"".join(tokens[t][2][k] if tokens[t][2] else s.encode() for t, s in zip(own, whole, strict=True)) for k in (0, 1)]
        live[row] &= spelled[0] == spelled[1] == "".join(whole).encode()
    # Tokens of the texts that have any, one text after the other.
    spoken = which[np.repeat(live, np.diff(first))]
    a, b = (taken(*flat([t[k] for t in tokens]), spoken)[0] for k in (0, 1))
    rows = np.flatnonzero(live)
    text_ends = np.cumsum(np.diff(texts.offs)[rows] + 1)
    a_ends, b_ends = np.cumsum(both.a_sizes[a], dtype=np.int64), np.cumsum(both.b_sizes[b], dtype=np.int64)
    i, j, closing = overlaps(a_ends, b_ends)
    a_bounds, b_bounds = (np.concatenate([[0], x[closing] + 1]) for x in (i, j))
    group_ends = a_ends[a_bounds[1:] - 1]
    of_text = np.zeros(texts.n + 1, np.int64)
    of_text[rows + 1] = np.diff(np.concatenate([[0], np.searchsorted(group_ends, text_ends, side="right")]))
    of_text = np.cumsum(of_text)

    group, pairs, times = products(a, a_bounds, b, b_bounds)
    listed, codes = np.unique(pairs, return_inverse=True)
    owner = np.searchsorted(of_text, group, side="right") - 1
    keys, back = np.unique(owner << 32 | codes, return_inverse=True)
    times = np.bincount(back, times, len(keys)).astype(np.int64)
    cuts = np.searchsorted(keys >> 32, np.arange(texts.n + 1))
    links = np.diff(np.concatenate([[0], np.cumsum(times)])[cuts])
    counts = {"n_a": np.diff(a_bounds[of_text]), "n_b": np.diff(b_bounds[of_text]), "n_groups": np.diff(of_text), "n_links": links}
    columns = {n: pa.array(c) for n, c in counts.items()} | {"groups": _spelled(a, a_bounds, b, b_bounds, of_text)}
    return columns, listed[keys & 0xFFFFFFFF], times, cuts


def _block(held: list[tuple], number: int) -> Iterator[pa.RecordBatch]:
    """The batches of a block, with its list of pairs in the first row."""
    listed, codes = np.unique(np.concatenate([pairs for _, _, pairs, _, _ in held]), return_inverse=True)
    codes, at = codes.astype(np.int32), 0
    for nth, (ids, columns, pairs, times, cuts) in enumerate(held):
        n = len(ids)
        once = lambda values, kind: pa.array([values if nth == 0 else None] + [None] * (n - 1), pa.list_(kind))  # noqa: B023, E731
        columns = {
            "doc_id": ids, **columns, "block": pa.array(np.full(n, number, np.int64)),
            "codes": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(codes[at : at + len(pairs)])),
            "times": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(times)),
            "pairs": once(listed, pa.int64()), "held": once(np.bincount(codes, minlength=len(listed)).astype(np.int32), pa.int32()),
        }
        at += len(pairs)
        yield pa.RecordBatch.from_arrays([columns[n] for n in NAMES], names=NAMES)


def aligned(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`ALIGNED` for each row: counts, the groups written out, and linked id pairs (codes: places in the block's `pairs`, which stand
    in its first row with the number of its documents that hold each; times: links of the document)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = pair(a_path, b_path), TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in gathered(batches, AT_ONCE):
            held.append((batch.column(0), *align_texts(batch.column(1), both)))
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield from _block(held, number)
                held, size, number = [], 0, number + 1
        if held:
            yield from _block(held, number)

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, ALIGNED)


def counted(rows: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents each id pair is linked, and whether no other pair of its first id is in
    more; a written table. `rows` is a written table of `aligned`."""
    each = rows.where("pairs is not null").select(F.inline(F.arrays_zip("pairs", "held"))).toDF("pair", "held")
    counts = saved(each.groupBy("pair").agg(F.sum("held").alias("count")), "counts")
    first = F.shiftright("pair", 32)
    most = counts.groupBy(first.alias("a")).agg(F.max("count").alias("most"))
    out = saved(counts.withColumn("a", first).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "scored")
    discard(counts)
    return out


def scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of `aligned` with n_best and count_sum instead of their pairs."""
    listed = rows.where("pairs is not null").select(F.col("block").alias("listed"), F.posexplode("pairs").alias("code", "pair"))
    listed = listed.join(counts, "pair").select("listed", "code", "count", "best")
    docs = rows.drop("pairs", "held")
    kept = [f for f in docs.schema.fields if f.name not in ("codes", "times", "block")]

    def of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        size = len(right)
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        code = right.column("code").to_numpy()
        count[code], best[code] = right.column("count").to_numpy(), right.column("best").to_numpy()
        left = left.combine_chunks()
        codes, times = (pc.list_flatten(left.column(c)).to_numpy() for c in ("codes", "times"))
        cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(left.column("codes")).to_numpy())])
        sums = [np.diff(np.concatenate([[0], np.cumsum(times * x[codes])])[cuts]) for x in (best, count)]
        return pa.table({f.name: left.column(f.name) for f in kept} | {"n_best": sums[0], "count_sum": sums[1]})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", n_best long, count_sum long"
    return docs.groupBy("block").cogroup(listed.groupBy("listed")).applyInArrow(of_block, schema)


def op13(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    found = aligned(docs, a_path, b_path)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    found = saved(found.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    counts = counted(found)
    return scored(found, counts)
