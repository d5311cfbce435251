import re

import numpy as np
import pyarrow as pa

from garim.llm import quality as Q
from tests.llm.conftest import words


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if line in seen and re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
        seen.add(line)
    n, repeated = len(ws), len(covered)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), lines, repeated, n < 50 or 100 * repeated > 50 * n


def test_counts_against_brute_force(docs_of, rng):
    texts = [None, "", " \n\t", "é😀 \x0b\x0c x", "a b c a b c a b c", "l1\nl1\n\n\n \n l1", "#*$%&|<> x y", "w " * 5000]
    for _ in range(60):
        ws = words(rng, rng.randint(0, 130), rng.choice([3, 20, 400]))
        texts.append("".join(w + rng.choice([" ", "\n", "  ", "\t", "\r\n"]) for w in ws))
    docs = docs_of(texts).withColumnRenamed("source", "kept")
    rows = {r.doc_id: r for r in Q.rate(docs, Q.fit([], np.zeros(0, int), np.zeros(0, bool))).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), text
        assert r.kept == (not r.base_failed)  # no labels: the base rules decide


def test_classifier_tells_held_out_texts(rng):
    def text(good):
        ws = words(rng, 80)
        return " ".join(ws) + "." if good else " ".join(w.upper() + "!!" for w in ws)

    labels = np.array([i % 3 != 0 for i in range(240)], int)
    texts = [text(y) for y in labels]
    model = Q.fit(texts[:160], labels[:160], np.arange(160) % 4 == 3)
    block = Q.Texts(pa.array(texts[160:]))
    hashes, _, _, first = Q._word_hashes(block)
    p = model.probability(model.raw(Q.grams(block, hashes, first)))
    assert ((p >= Q.KEEP) == (labels[160:] == 1)).mean() > 0.97


def test_sample_is_bounded_and_skips_odd_labels(spark, docs_of):
    docs = docs_of([f"text {i}" for i in range(30)])
    rows = [(i, 1 if i % 2 else 0, 0) for i in range(30)] + [(None, 1, 0), (3, None, 0), (4, 7, 0), (5, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    found = Q.labelled_sample(docs, labels, "quality", 12)
    assert len(found) == 12 and all(r.label in (0, 1) for r in found)
    assert Q.rate(docs_of([]), Q.train(docs, labels.limit(0))).count() == 0
