"""Quality rules: exact counts of every text, and a calibrated classifier on hashed n-grams.

The classifier is a logistic regression on the relative frequencies of hashed word n-grams (one and
two words) and character n-grams (two to four bytes). It is trained in numpy on a bounded sample of
labelled rows (`SAMPLE`, those of least hash), and Platt-calibrated on a part of the sample that was
held back from training. Texts are scored in Arrow batches against the fixed threshold `KEEP`.

Null and empty texts have no words and fail the base rules. Without usable labels every text scores 1,
so the base rules alone decide. Labels that are null, or other than 0 and 1, are left out. Repeated rows are rated
each; of labels that differ under one id the least counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garim.llm.shared import Texts, U, per_text_sum, platt, with_columns, xxh64

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 2500
#: A text is kept at this calibrated probability of quality or above.
KEEP = 0.5
MIN_WORDS = 50
MAX_REPEATED = 0.5
SLOTS = 16
KINDS = ("word", "two words", "2 bytes", "3 bytes", "4 bytes")
STEPS = 80
RATE = 0.05
DECAY = 1e-6
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_MIX = U(0x9E3779B97F4A7C15)
_NEXT = U(0xC2B2AE3D27D4EB4F)


def _after(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the n-grams of `size` items, and the positions of all items where one starts."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    return out, np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], counts)


def grams(texts: Texts, words: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram the slots of all its occurrences, and each text's first one (n + 1)."""
    down = U(64 - SLOTS)
    found = [(((words * _MIX) >> down).astype(np.int32), first)]
    bounds, at = _after(first, 2)
    found.append((((((words[at] * _NEXT) ^ words[at + 1]) * _MIX) >> down).astype(np.int32) if len(at) else at, bounds))
    raw = texts.buf.astype(np.uint32)
    for size in (2, 3, 4):
        bounds, at = _after(texts.offs, size)
        value = raw[at] if len(at) else at.astype(np.uint32)
        for k in range(1, size):
            value = value << np.uint32(8) | raw[at + k]
        found.append((((value * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS)).astype(np.int32), bounds))
    return found


def _word_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = texts.words()
    return xxh64(texts.buf, starts, ends), starts, ends, first


class Model:
    """Weights by kind of n-gram and slot, a bias, and the calibration's slope and offset."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def raw(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        total = np.full(len(found[0][1]) - 1, self.bias)
        for w, (slots, bounds) in zip(self.weights, found, strict=True):
            total += per_text_sum(w[slots].astype(np.float64), bounds) / np.maximum(np.diff(bounds), 1)
        return total

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -40, 40)))


def _features(texts: list[str | None], at_once: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and relative frequency of all n-grams of all texts; a few texts at a time."""
    found: list[list[np.ndarray]] = [[], [], []]
    for start in range(0, len(texts), at_once):
        block = Texts(pa.array(texts[start : start + at_once], pa.string()))
        words, _, _, first = _word_hashes(block)
        for kind, (slots, bounds) in enumerate(grams(block, words, first)):
            text = np.repeat(np.arange(block.n), np.diff(bounds))
            pair, count = np.unique(text << SLOTS | slots, return_counts=True)
            found[0].append((start + (pair >> SLOTS)).astype(np.int32))
            found[1].append(((pair & ((1 << SLOTS) - 1)) + (kind << SLOTS)).astype(np.int32))
            found[2].append((count / np.maximum(np.diff(bounds), 1)[pair >> SLOTS]).astype(np.float32))
    out = []
    for part in found:
        out.append(np.concatenate(part))
        part.clear()
    return tuple(out)


#: Features that are multiplied at once.
AT_ONCE = 1 << 20


def _dot(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The sum of value times weight for each row."""
    out = np.zeros(n)
    for a in range(0, len(rows), AT_ONCE):
        part = slice(a, a + AT_ONCE)
        out += np.bincount(rows[part], values[part] * weights[columns[part]], minlength=n)
    return out


def fit(texts: list[str | None], labels: np.ndarray, fold: np.ndarray) -> Model:
    """A model of P(label = 1); rows with `fold` set calibrate it, the others train it."""
    always = Model(np.zeros((len(KINDS), 1 << SLOTS), np.float32), 40.0)
    train = ~fold
    if len(set(labels[train])) < 2:
        return always
    rows, columns, values = _features(texts)
    here = train[rows]
    # One array at a time, since each is large.
    r, rest_r = rows[here], rows[~here]
    del rows
    c, rest_c = columns[here], columns[~here]
    del columns
    v, rest_v = values[here], values[~here]
    del values, here
    weights = np.zeros(len(KINDS) << SLOTS)
    bias, y = 0.0, labels.astype(float)
    share = y[train].mean()
    balance = np.where(train, np.where(y == 1, 0.5 / share, 0.5 / (1 - share)), 0) / train.sum()
    m1, m2, b1, b2 = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = _dot(r, c, v, weights, len(texts)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * balance
        g, gb = _dot(c, r, v, error, len(weights)) + DECAY * weights, error.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        weights -= RATE * 10 * fix * m1 / (np.sqrt(m2) + 1e-8)
        bias -= RATE * fix * b1 / (np.sqrt(b2) + 1e-8)
    model = Model(weights.reshape(len(KINDS), -1).astype(np.float32), bias)
    if len(set(labels[fold])) == 2:
        raw = _dot(rest_r, rest_c, rest_v, weights, len(texts)) + bias
        model.slope, model.offset = platt(raw[fold], y[fold])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> list:
    """At most `most` (doc_id, text, label) rows of least hash; the bound is on what reaches the driver. Of labels or
    texts that are repeated under one id the least counts, so that the sample is the same each time."""
    chosen = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(column).alias("label"))
    few = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # at most `most` rows
    return docs.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy("doc_id").collect()


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = SAMPLE) -> Model:
    rows = labelled_sample(docs, labels, column, most)
    fold = np.array([i % 4 == 3 for i in range(len(rows))], bool)
    return fit([r.text for r in rows], np.array([r.label for r in rows], int), fold)


def repeated_words(words: np.ndarray, first: np.ndarray, size: int = 3) -> np.ndarray:
    """For each text, how many words lie in a window of `size` words found twice or more in that text."""
    bounds, at = _after(first, size)
    if not len(at):
        return np.zeros(len(first) - 1, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(bounds)).astype(U)
    key = (text + U(1)) * _MIX
    for k in range(size):
        key = (key ^ words[at + k]) * _NEXT
        key ^= key >> U(29)
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[at[again] + k] = True
    return per_text_sum(covered.astype(np.int64), first)


def duplicate_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    lines = (text or "").split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, found = set(), 0
    for line in lines:
        if line in seen and line.strip(" \t\r\x0b\x0c"):
            found += 1
        seen.add(line)
    return found


def rate(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with the counts, `base_failed`, `quality` (calibrated) and `kept`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by SLOTS

    def start():
        scorer = shared.value

        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = Texts(batch.column(text))
            words, starts, ends, first = _word_hashes(texts)
            lead = np.concatenate([[0], np.cumsum((texts.buf & 0xC0) != 0x80)])
            counts = np.diff(first)
            chars = per_text_sum(lead[ends] - lead[starts], first)
            symbols = per_text_sum(_SYMBOLS[texts.buf].astype(np.int64), texts.offs)
            lines = np.array([duplicate_lines(t) for t in batch.column(text).to_pylist()], np.int64)
            repeated = repeated_words(words, first)
            failed = (counts < MIN_WORDS) | (repeated > MAX_REPEATED * counts)
            good = scorer.probability(scorer.raw(grams(texts, words, first)))
            longs = [pa.array(x.astype(np.int64)) for x in (counts, chars, symbols, lines, repeated)]
            return [*longs, pa.array(failed), pa.array(~failed & (good >= KEEP)), pa.array(good)]

        return make

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    fields = [T.StructField(n, T.LongType()) for n in names]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    return with_columns(docs, [*fields, T.StructField("quality", T.DoubleType())], start)
