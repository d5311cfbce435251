import zlib

import numpy as np
import pyarrow as pa

from garim.llm import toxicity as X
from tests.llm.conftest import words


def corpus(rng, n):
    rows = []
    for i in range(n):
        lang, toxic = ("en", "de")[i % 2], i % 3 == 0
        ws = words(rng, rng.randint(3, 60))
        if toxic:
            ws.insert(rng.randrange(len(ws)), rng.choice(["badword", "awfulword"]) if lang == "en" else "Schimpf" + rng.choice(["er", "en", "ung", "lich"]))
        rows.append((" ".join(ws), lang, int(toxic)))
    return rows


def test_held_out_accuracy_and_thresholds(rng):
    rows = corpus(rng, 500)
    train, test = rows[:350], [*rows[350:], ("a Schimpfheit b", "de", 1)]
    net = X.fit([r[0] for r in train], np.array([r[2] for r in train]), [r[1] for r in train], np.arange(350) % 5 == 3)
    score = net.score(*X.slots(pa.array([r[0] for r in test])))
    assert ((score >= X.PREDICT) == [r[2] == 1 for r in test]).mean() > 0.96
    assert set(net.thresholds) == {"en", "de"} and all(0 < t < 1 for t in net.thresholds.values())
    with_, without = net.score(*X.slots(pa.array(["w1 " * 30000 + "badword", "w1 " * 30000])))
    assert with_ > without  # nothing is cut off


def test_query(spark, docs_of, rng):
    rows = corpus(rng, 200)
    docs = docs_of([r[0] for r in rows] + [None, ""])
    labels = spark.createDataFrame([(i, 1, r[2]) for i, r in enumerate(rows)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert not any(r.doc_id for r in X.sample(docs, labels.where("doc_id is null"))) and len(X.sample(docs, labels, 20)) == 20
    found = {r.doc_id: r for r in X.op5(docs, labels).collect()}
    assert len(found) == 202 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    held = [i for i in range(200) if found[i].held_out]
    assert 20 < len(held) < 90 and np.mean([found[i].predicted == rows[i][2] for i in held]) > 0.9


def test_no_labels_and_empty(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in X.op5(docs_of(["a", None]), labels).collect()] == [0.0, 0.0]
    assert X.op5(docs_of([]), labels).count() == 0


def test_training_improves_on_the_start(rng, monkeypatch):
    rows = corpus(rng, 400)
    texts, y, langs, fold = [r[0] for r in rows[:300]], np.array([r[2] for r in rows[:300]]), [r[1] for r in rows[:300]], np.arange(300) % 5 == 3
    truth, loss = np.array([r[2] for r in rows[300:]]), []
    for epochs in (0, X.EPOCHS):
        monkeypatch.setattr(X, "EPOCHS", epochs)
        score = X.fit(texts, y, langs, fold).score(*X.slots(pa.array([r[0] for r in rows[300:]])))
        loss.append(-np.log(np.where(truth == 1, score, 1 - score)).mean())
    assert loss[1] < loss[0]


def test_scores_by_definition(rng):
    rows = corpus(rng, 60)
    net = X.fit([r[0] for r in rows], np.array([r[2] for r in rows]), [r[1] for r in rows], np.arange(60) % 4 == 3)
    for text, _, _ in rows[:20]:
        ids, first = X.slots(pa.array([text]))
        vectors, pooled = net.embedding[ids].sum(axis=1), []
        for width, filters, bias in zip(X.WIDTHS, net.filters, net.bias, strict=True):
            for f in range(X.FILTERS):
                values = [sum(float(vectors[i + j] @ filters[j][:, f]) for j in range(width)) + bias[f] for i in range(len(ids) - width + 1)]
                pooled.append(max([0.0, *values]))
        raw = float(np.dot(pooled, net.out) + net.shift)
        expected = 1 / (1 + np.exp(-(net.slope * raw + net.offset)))
        assert abs(net.score(ids, first)[0] - expected) < 1e-3


def test_all_labelled_rows_are_learnt_from(spark, docs_of, rng):
    """Far more rows than the starting network is fitted on: words, scores and thresholds of the rest count too."""
    rows = corpus(rng, 1200)
    docs = docs_of([r[0] for r in rows]).join(spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "doc_id long, of string"), "doc_id").drop("lang").withColumnRenamed("of", "lang")
    labels = spark.createDataFrame([(i, 1, r[2]) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    net = X.train(docs, labels, 12)
    held = [r for i, r in enumerate(rows) if zlib.crc32(str(i).encode()) % 4 == 2]
    score = net.score(*X.slots(pa.array([r[0] for r in held])))
    assert ((score >= X.PREDICT) == [r[2] == 1 for r in held]).mean() > 0.9
    assert set(net.thresholds) == {"en", "de"} and all(0 < t < 1 for t in net.thresholds.values())
