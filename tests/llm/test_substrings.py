import hashlib
import re

import pytest

from garim.llm import substrings as S


def brute(texts, span):
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts}
    low = {}
    for i, ws in split.items():
        for p in range(len(ws) - span + 1):
            key = tuple(ws[p : p + span])
            low[key] = min(low.get(key, i), i)
    out = {}
    for i, ws in split.items():
        gone = [False] * len(ws)
        for p in range(len(ws) - span + 1):
            if low[tuple(ws[p : p + span])] < i:
                gone[p : p + span] = [True] * span
        out[i] = (len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone) if not g))
    return out


@pytest.mark.parametrize(("vocabulary", "span", "anchor"), [(3, 12, 5), (400, 12, 5), (400, 50, 14)])
def test_against_brute_force(spark, rng, vocabulary, span, anchor):
    base = [[f"w{rng.randint(0, vocabulary)}" for _ in range(rng.randint(0, 200))] for _ in range(5)]
    texts = []
    for i in range(70):
        ws = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            a = rng.randint(0, len(b))
            ws += b[a : rng.randint(a, len(b))]
            if ws and rng.random() < 0.3:
                ws[rng.randrange(len(ws))] = "nEw,é"
        if i % 9 == 0:
            ws = ["a", "b", "c"] * 40
        texts.append((i * 3, " \n".join(ws)))
    texts += [(1000, None), (1001, ""), (1002, " \t ")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in S.without_repeats(df, span=span, anchor=anchor).collect()}
    expected = brute(texts, span)
    assert found == expected and sum(x[1] for x in expected.values())


def test_query_nulls_repeats_and_clashes(spark, rng):
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(3000))
    rows = [(5, long, 1), (5, long, 2), (9, long + " tail", 3), (None, long, 4), (2, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    found = {r.doc_id: r for r in S.op3(df).collect() if r.doc_id != 5}
    assert found[9].n_removed == 3000 and found[9].kept_sha256 == hashlib.sha256(b"tail").hexdigest()
    assert found[None].n_removed == 0 and found[2].n_words == 0
    assert [r.n_removed for r in S.op3(df).where("doc_id = 5").collect()] == [0, 0]
    assert S.op3(df.limit(0)).count() == 0
    kept = S.without_repeats(df.withColumnRenamed("n_words", "spans")).where("doc_id = 9").first()
    assert kept.kept == "tail" and kept.spans == 3
