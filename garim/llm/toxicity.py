"""Toxicity by a convolutional text classifier trained in numpy.

Every word is the sum of hashed embeddings: of the word in lower case, and of its first 4, 5 and 6 bytes,
so that unseen forms of a word share its beginning. Filters of several widths slide over the words, the
maximum of each filter over the whole text is pooled, and a logistic unit gives the score. Texts of any
length are scored whole, in Arrow batches; a table of each slot's filter responses stands in for the
product of embeddings and filters, which gives the same sums.

Training starts from a rough guess: the first dimension of each slot's embedding is its log-odds of standing in a
toxic text of the training part, and one filter of each width reads that dimension. The network is then trained as a
whole, all weights free.

The network learns from all labelled rows whose crc32(doc_id as text) mod 4 is not 2; the rest is held out. It starts from
one fitted on the driver on at most `SAMPLE` of these rows, half of them toxic where there are as many, of least hash. Where
there are more, it then goes `ROUNDS` times over all of them: each task trains a copy on its rows, and the copies' weights, by
blocks of them, are averaged by rows. A quarter of the rows, by hash of the id, is kept from training and calibrates the score,
and gives each language the threshold that separates its rows best, by counts of all its scores in steps of 1 / `STEPS`; neither
language nor source nor id is an input of the score.

Repeated rows are scored each; of labels or texts that differ under one id the least is learnt from.
Null and empty texts have no words: every filter pools its floor, and they get the score of that. Without
labels of both kinds every score is 0. Labels other than 0 and 1 are left out.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garim.llm.chunks import gathered
from garim.llm.shared import Texts, U, discard, platt, saved, small_batches, with_columns, xxh64

#: Labelled rows that the driver fits the starting network on, at most.
SAMPLE = 2400
#: Passes over all labelled rows, where there are more.
ROUNDS = 2
#: Bytes of text that a task trains on at once, and weights in a row of an average.
AT_ONCE, BLOCK = 4 << 20, 1 << 14
#: Raw scores are counted in such parts of one, between -LIMIT and LIMIT.
STEPS, LIMIT = 256, 30
PREDICT = 0.3
SLOTS = 16
STARTS = (4, 5, 6)
SIZE = 12
WIDTHS = (1, 2, 3)
FILTERS = 6
EPOCHS = 12
BATCH = 64
RATE = 0.03
_BETWEEN = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])


def slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Embedding slots of all words (a row each), and each text's first word (n + 1 of them)."""
    texts = Texts(pc.utf8_lower(column))
    starts, ends, first = texts.words(_BETWEEN)
    kinds = [xxh64(texts.buf, starts, ends, 1)]
    kinds += [xxh64(texts.buf, starts, np.minimum(ends, starts + k), 2) for k in STARTS]
    return np.stack([(k >> U(64 - SLOTS)).astype(np.int32) for k in kinds], axis=1), first


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embedding = (rng.standard_normal((1 << SLOTS, SIZE)) * 0.1).astype(np.float32)
        self.filters = [(rng.standard_normal((w, SIZE, FILTERS)) * 0.3 / w).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.3).astype(np.float32)
        self.shift = np.float32(-1.0)
        self.slope, self.offset = 1.0, 0.0
        self.thresholds: dict[str, float] = {}
        self.fitted = False

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of all filters over each text, and the words where they start (-1: nowhere)."""
        n = len(first) - 1
        best = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        where = np.full((n, len(WIDTHS) * FILTERS), -1)
        for k, width in enumerate(WIDTHS):
            count = np.maximum(np.diff(first) - width + 1, 0)
            bounds = np.concatenate([[0], np.cumsum(count)])
            if not bounds[-1]:
                continue
            at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], count)
            responses = self.tables[k] if self.tables else self._responses(k)
            parts = [sum(r[ids[:, c]] for c in range(ids.shape[1])) for r in responses]
            total = parts[0][at] + self.bias[k]
            for j in range(1, width):
                total += parts[j][at + j]
            rows = np.flatnonzero(count)
            top = np.maximum.reduceat(total, bounds[rows], axis=0)
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            best[rows, columns] = np.maximum(top, 0)
            if self.training:
                owner = np.repeat(np.arange(len(rows)), count[rows])
                for f in range(FILTERS):
                    hit = np.flatnonzero(total[:, f] == top[owner, f])[::-1]
                    where[rows[owner[hit]], k * FILTERS + f] = at[hit]
        where[best <= 0] = -1
        return best, where

    training = False
    tables: list[list[np.ndarray]] | None = None

    def _responses(self, k: int) -> list[np.ndarray]:
        """What each slot adds to the filters of one width, by place within the filter."""
        return [self.embedding @ self.filters[k][j] for j in range(WIDTHS[k])]

    def raw(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(ids, first)[0] @ self.out + self.shift

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(first) - 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(ids, first).astype(float) + self.offset, -40, 40)))


def _start_embedding(net: Network, ids: np.ndarray, first: np.ndarray, y: np.ndarray) -> None:
    """Let the first dimension start at each slot's log-odds of standing in a toxic text."""
    text = np.repeat(np.arange(len(y)), np.diff(first))
    for c in range(ids.shape[1]):
        pairs = np.unique(text.astype(np.int64) << SLOTS | ids[:, c])
        slot, label = pairs & ((1 << SLOTS) - 1), y[pairs >> SLOTS]
        pos, neg = (np.bincount(slot[label == v], minlength=1 << SLOTS) for v in (1, 0))
        odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / ((1 - y).sum() + 1))
        seen = pos + neg > 0
        net.embedding[seen, 0] = np.maximum(net.embedding[seen, 0], np.clip(odds[seen], -3, 3) / 3)
    for f in net.filters:
        f[0, 0, 0] = 1.0
    net.out[::FILTERS] = 1.0


def _texts_of(ids: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = first[rows + 1] - first[rows]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return ids[np.arange(bounds[-1]) + np.repeat(first[rows] - bounds[:-1], sizes)], bounds


class Learner:
    """Gradient steps for a network, each weight's by its own past gradients."""

    def __init__(self, net: Network):
        self.net = net
        self.weights = [net.out, *net.filters, *net.bias]
        self.memory = [np.full_like(w, 1e-3) for w in self.weights]
        self.rows_memory, self.shift_memory = np.full((1 << SLOTS, 1), 1e-3, np.float32), 1e-3

    def learn(self, ids: np.ndarray, first: np.ndarray, y: np.ndarray, order: np.ndarray) -> None:
        """One pass over texts in this order."""
        net, rows_memory = self.net, self.rows_memory
        net.training = True
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            words, bounds = _texts_of(ids, first, rows)
            best, where = net.pooled(words, bounds)
            error = (1 / (1 + np.exp(-(best @ net.out + net.shift))) - y[rows]) / len(rows)
            grads = [best.T @ error, *(np.zeros_like(f) for f in net.filters), *(np.zeros_like(b) for b in net.bias)]
            back = error[:, None] * net.out
            touched, steps = [], []
            for k, width in enumerate(WIDTHS):
                text, f = np.nonzero(where[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
                g, at = back[text, k * FILTERS + f], where[text, k * FILTERS + f]
                np.add.at(grads[1 + len(WIDTHS) + k], f, g)
                for j in range(width):
                    vectors = net.embedding[words[at + j]].sum(axis=1)
                    np.add.at(grads[1 + k][j].T, f, g[:, None] * vectors)
                    push = g[:, None] * net.filters[k][j][:, f].T
                    touched.append(words[at + j].ravel())
                    steps.append(np.repeat(push, words.shape[1], axis=0))
            for w, m, g in zip(self.weights, self.memory, grads, strict=True):
                m += g * g
                w -= RATE * g / np.sqrt(m)
            self.shift_memory += float(error.sum()) ** 2
            net.shift -= np.float32(RATE * error.sum() / np.sqrt(self.shift_memory))
            slot, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            total = np.zeros((len(slot), SIZE), np.float32)
            np.add.at(total, inverse, np.concatenate(steps))
            rows_memory[slot] += (total * total).mean(axis=1, keepdims=True)
            net.embedding[slot] -= RATE * total / np.sqrt(rows_memory[slot])
        net.training = False


def fit(texts: list[str | None], labels: np.ndarray, langs: list[str | None], fold: np.ndarray, seed: int = 7) -> Network:
    """A network of P(label = 1); rows with `fold` set calibrate it, the others train it."""
    net, y = Network(seed), labels.astype(np.float32)
    train = np.flatnonzero(~fold)
    if len(set(labels[~fold])) < 2:
        return net
    net.fitted = True
    ids, first = slots(pa.array(texts, pa.string()))
    _start_embedding(net, *_texts_of(ids, first, train), labels[train])
    rng = np.random.default_rng(seed)
    learner = Learner(net)
    for _ in range(EPOCHS):
        learner.learn(ids, first, y, rng.permutation(train))
    _calibrate(net, ids, first, labels, langs, np.flatnonzero(fold))
    return net


def _calibrate(net: Network, ids: np.ndarray, first: np.ndarray, labels: np.ndarray, langs: list[str | None], rows: np.ndarray) -> None:
    if len(set(labels[rows])) < 2:
        return
    words, bounds = _texts_of(ids, first, rows)
    raw, y = net.raw(words, bounds).astype(float), labels[rows]
    a, b = platt(raw, y)
    if a > 0:
        net.slope, net.offset = a, b
    score = net.score(words, bounds)
    of = np.array([langs[i] or "" for i in rows])
    for lang in sorted(set(of.tolist())):
        s, t = score[of == lang], y[of == lang]
        if len(set(t)) < 2:
            continue
        cuts = np.unique(np.concatenate([s, [PREDICT]]))
        value = [2 * ((s >= c) & (t == 1)).sum() / max(1, (s >= c).sum() + (t == 1).sum()) for c in cuts]
        good = cuts[np.flatnonzero(np.array(value) == max(value))]
        net.thresholds[lang] = float(good[np.abs(good - PREDICT).argmin()])


def _open(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of all rows to learn from; the least of labels that differ."""
    open_ = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    return open_.groupBy("doc_id").agg(F.min("toxic").alias("label"))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list:
    """At most `most` rows (text, lang, label) to learn from, none of them held out."""
    open_, chosen = _open(labels), None
    for label in (1, 0):
        part = open_.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
        chosen = part if chosen is None else chosen.union(part)
    few = F.broadcast(chosen)  # at most `most` rows
    rows = docs.select("doc_id", "text", "lang").join(few, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("text", "lang")).alias("row"))
    return rows.select("doc_id", "label", "row.text", "row.lang").orderBy("doc_id").collect()


def held_out(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def _calibrates(key: str):
    return F.pmod(F.xxhash64(F.lit("fold"), key), F.lit(4)) == 3


def _trained(rows: DataFrame, net: Network) -> Network:
    """The average, by rows, of copies of a network that tasks train on rows (text, label)."""
    shared = rows.sparkSession.sparkContext.broadcast(net)  # its size is fixed by SLOTS and SIZE
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, n = copy.deepcopy(shared.value), 0
        learner, rng = Learner(mine), np.random.default_rng(7)
        for batch in gathered(batches, AT_ONCE):
            learner.learn(*slots(batch.column(0)), batch.column(1).to_numpy().astype(np.float32), rng.permutation(len(batch)))
            n += len(batch)
        if n:
            flat = np.concatenate([w.ravel() for w in (mine.embedding, *learner.weights, np.array([mine.shift], np.float32))])
            parts = [flat[a : a + BLOCK].tobytes() for a in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["block", "n", "part"])

    def mean(group: pa.Table) -> pa.Table:
        n, total = group.column("n").to_pylist(), 0.0
        for k, part in zip(n, group.column("part"), strict=True):
            total = total + np.frombuffer(part.as_buffer(), np.float32) * (k / sum(n))
        return pa.table({"block": group.column("block")[:1].cast(pa.int32()), "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    made = rows.select("text", "label").mapInArrow(run, "block int, n long, part binary").groupBy("block").applyInArrow(mean, "block int, part binary")
    flat = np.frombuffer(b"".join(r["part"] for r in sorted(made.collect(), key=lambda r: r["block"])), np.float32)
    if not len(flat):
        return net
    out, at = copy.deepcopy(net), 0
    for w in (out.embedding, out.out, *out.filters, *out.bias):
        w[...] = flat[at : at + w.size].reshape(w.shape)
        at += w.size
    out.shift = flat[at]
    return out


def _calibrate_by(rows: DataFrame, net: Network) -> None:
    """Slope, offset and thresholds from counts of the raw scores of all rows (text, label, lang)."""
    net.slope, net.offset, net.thresholds = 1.0, 0.0, {}
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def start():
        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            raw = np.clip(shared.value.raw(*slots(batch.column("text"))), -LIMIT, LIMIT)
            return [pa.array(np.rint(raw * STEPS).astype(np.int32))]

        return make

    scored = with_columns(rows, [T.StructField("step", T.IntegerType())], start)
    ones = F.sum("label").cast("long").alias("ones")
    counted = saved(scored.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "step").agg(ones, F.count("*").alias("n")), "scores")
    all_ = counted.groupBy("step").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).orderBy("step").collect()  # 2 * LIMIT * STEPS rows at most
    n1, n0 = (np.array([f(r) for r in all_], float) for f in (lambda r: r["ones"], lambda r: r["n"] - r["ones"]))
    if n1.sum() and n0.sum():
        raw = np.array([r["step"] for r in all_], float) / STEPS
        a, b = platt(np.concatenate([raw, raw]), np.repeat([1, 0], len(raw)), np.concatenate([n1, n0]))
        if a > 0:
            net.slope, net.offset = a, b
        slope, offset = net.slope, net.offset

        def best(group: pa.Table) -> pa.Table:
            group = group.sort_by([("step", "descending")])
            of, n = (group.column(c).to_numpy() for c in ("ones", "n"))
            cut = 1 / (1 + np.exp(-np.clip(slope * group.column("step").to_numpy() / STEPS + offset, -40, 40)))
            value = 2 * np.cumsum(of) / (np.cumsum(n) + of.sum())
            good = cut[value == value.max()]
            both = int(0 < of.sum() < n.sum())
            return pa.table({"lang": group.column("lang").slice(0, both), "cut": pa.array([good[np.abs(good - PREDICT).argmin()]] * both, pa.float64())})

        net.thresholds = {r["lang"]: r["cut"] for r in counted.groupBy("lang").applyInArrow(best, "lang string, cut double").collect()}  # a row for each language
    discard(counted)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Network:
    rows = sample(docs, labels, most)
    fold = np.array([i % 4 == 3 for i in range(len(rows))], bool)
    if _open(labels).count() <= len(rows):
        return fit([r.text for r in rows], np.array([r.label for r in rows], int), [r.lang for r in rows], fold)
    of = docs.select("doc_id", "text", "lang").where(~held_out("doc_id")).join(_open(labels), "doc_id")
    of = of.groupBy("doc_id", "label").agg(F.min(F.struct("text", "lang")).alias("row"))
    learnt = saved(of.select("label", "row.text", "row.lang", _calibrates("doc_id").alias("fold")), "labelled")
    few = docs.sparkSession.createDataFrame([(r.doc_id,) for r in rows], "doc_id long").select("doc_id", _calibrates("doc_id").alias("fold"))
    kept = {r.doc_id for r in few.where("fold").collect()}
    fold = np.array([r.doc_id in kept for r in rows], bool)
    net = fit([r.text for r in rows], np.array([r.label for r in rows], int), [r.lang for r in rows], fold)
    net.fitted = learnt.where("not fold").select("label").distinct().count() == 2
    for _ in range(ROUNDS if net.fitted else 0):
        net = _trained(learnt.where("not fold"), net)
    if net.fitted:
        _calibrate_by(learnt.where("fold"), net)
    discard(learnt)
    return net


def score(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """docs with `score`."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # its size is fixed by SLOTS and SIZE

    def start():
        model = shared.value
        model.tables = [model._responses(k) for k in range(len(WIDTHS))]

        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array(model.score(*slots(batch.column(text))).astype(float))]

        return make

    return with_columns(docs, [T.StructField("score", T.DoubleType())], start)


def toxic(docs: DataFrame, net: Network, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with `score`, the `threshold` of its language (`PREDICT` for others) and `toxic`."""
    threshold = F.lit(PREDICT)
    for name, value in net.thresholds.items():
        threshold = F.when(F.coalesce(F.col(lang), F.lit("")) == name, F.lit(value)).otherwise(threshold)
    return score(docs, net, text).withColumn("threshold", threshold).withColumn("toxic", F.col("score") >= F.col("threshold"))


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = toxic(docs.select("doc_id", "text", "lang"), train(docs, labels))
    return found.select(
        "doc_id",
        F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT).cast("int").alias("predicted"),
        "threshold",
        "toxic",
    )
