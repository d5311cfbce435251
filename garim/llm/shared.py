"""What the corpus operators share: the shared folder, Arrow plumbing and numpy work on text buffers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

U = np.uint64


# --- tables in the shared folder -------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share. Where the session names none, a local master gets a local one; a cluster's
    machines share no local folder, so there it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file:///tmp/garim-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/garim-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that `saved` returned, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Arrow plumbing ---------------------------------------------------------------------------


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by bytes as well as rows: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def with_columns(
    df: DataFrame, fields: list[T.StructField], start: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]
) -> DataFrame:
    """df with computed columns, in Arrow batches. `start` runs once a task and returns the function
    that computes the columns of a batch. An input column with the name of a new one is replaced."""
    small_batches(df.sparkSession)
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            made = make(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + made, names=names + [f.name for f in fields]
            )

    return df.mapInArrow(run, T.StructType(kept + fields))


# --- text buffers -----------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Texts:
    """The texts of an Arrow batch as one byte buffer; null counts as empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        _, offsets, data = column.buffers()
        offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.offs = offs - offs[0]
        self.buf = raw[offs[0] : offs[-1]]
        self.n = len(column)

    @classmethod
    def of(cls, buf: np.ndarray, offs: np.ndarray) -> Texts:
        self = cls.__new__(cls)
        self.buf, self.offs, self.n = buf, offs, len(offs) - 1
        return self

    def lowered(self) -> Texts:
        """A-Z in lower case."""
        return Texts.of(_LOWER[self.buf], self.offs)

    def words(self, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and the index of each text's first word (n + 1 of them)."""
        edge = np.zeros(len(self.buf) + 1, bool)
        edge[self.offs] = True
        inside = ~separator[self.buf]
        before = np.empty(len(inside), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(inside), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offs)

    def single_spaced(self) -> Texts:
        """Each text's words joined by one space."""
        starts, ends, first = self.words()
        space = _SPACE[self.buf]
        keep = ~space
        last = np.zeros(len(starts), bool)
        last[first[1:][first[1:] > first[:-1]] - 1] = True
        counts = np.diff(np.concatenate([[0], np.cumsum(keep)])[self.offs])
        words = np.diff(first)
        offs = np.concatenate([[0], np.cumsum(counts + np.maximum(words - 1, 0))])
        out = np.full(offs[-1], 32, np.uint8)
        # A kept byte moves to its place among kept bytes plus the spaces put in before it.
        gap = np.ones(len(starts), np.int64)
        gap[last] = 0
        before = np.concatenate([[0], np.cumsum(gap)])[:-1]
        lens = ends - starts
        shift = np.repeat(before, lens)
        out[np.arange(int(lens.sum())) + shift] = self.buf[keep]
        return Texts.of(out, offs)


# --- XXH64 over many spans at once --------------------------------------------------------------

_P1, _P2, _P3 = U(11400714785074694791), U(14029467366897019727), U(1609587929392839161)
_P4, _P5 = U(9650029242287828579), U(2870177450012600261)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def _xxh64_group(q: np.ndarray, d: np.ndarray, b: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """XXH64 of the spans of one length that start at `at`."""
    n, pos = len(at), 0
    s = U(seed)
    if size >= 32:
        acc = [np.full(n, s + _P1 + _P2), np.full(n, s + _P2), np.full(n, s), np.full(n, s - _P1)]
        while pos + 32 <= size:
            for k in range(4):
                acc[k] = _round(acc[k], q[at + (pos + 8 * k)])
            pos += 32
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            h = (h ^ _round(np.zeros(n, U), a)) * _P1 + _P4
    else:
        h = np.full(n, s + _P5)
    h = h + U(size)
    while pos + 8 <= size:
        h = _rotl(h ^ _round(np.zeros(n, U), q[at + pos]), 27) * _P1 + _P4
        pos += 8
    if pos + 4 <= size:
        h = _rotl(h ^ (d[at + pos].astype(U) * _P1), 23) * _P2 + _P3
        pos += 4
    while pos < size:
        h = _rotl(h ^ (b[at + pos].astype(U) * _P5), 11) * _P1
        pos += 1
    h = (h ^ (h >> U(33))) * _P2
    h = (h ^ (h >> U(29))) * _P3
    return h ^ (h >> U(32))


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of buf[start:end] for every span, in groups of equal length."""
    out = np.zeros(len(starts), U)
    if not len(starts):
        return out
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    q = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    d = np.ndarray((len(buf) + 1,), "<u4", padded, strides=(1,))
    lens = ends - starts
    order = np.argsort(lens, kind="stable")
    sizes = lens[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(sizes)) + 1, [len(sizes)]])
    with np.errstate(over="ignore"):
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[a:z]
            size = int(sizes[a])
            if z - a < 8 and size > 32:
                for i in rows:
                    out[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed)
            else:
                out[rows] = _xxh64_group(q, d, padded, starts[rows], size, seed)
    return out


def per_text_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def strings(values: Iterable[str | None]) -> pa.Array:
    return pa.array(list(values), pa.string())


def platt(raw: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset that turn raw scores into probabilities: logistic regression with Platt's
    smoothed targets, by Newton steps that are halved until they help. `n`: how often each score counts."""
    n = np.ones(len(raw)) if n is None else n
    middle = float(np.average(raw, weights=n))
    spread = float(np.sqrt(np.average((raw - middle) ** 2, weights=n))) or 1.0
    x, ones = (raw - middle) / spread, y == 1
    n1, n0 = n[ones].sum(), n[~ones].sum()
    target = np.where(ones, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((n * (np.logaddexp(0, z) - target * z)).sum() + 1e-3 * a * a)

    a, b = 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = n * p * (1 - p)
        g = np.array([(n * (p - target) * x).sum() + 2e-3 * a, (n * (p - target)).sum()])
        h = np.array([[(w * x * x).sum() + 2e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > loss(a, b):
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-8:
            break
    return a / spread, b - a * middle / spread
