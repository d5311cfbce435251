import numpy as np
import pyarrow as pa

from garim.llm import decontaminate as D
from tests.llm.conftest import words


def brute_tile(text, item, least):
    """Greedy string tiling by looking at every pair of places, longest match first."""
    used, covered, tiles = [False] * len(text), [False] * len(item), 0
    while True:
        best = (least - 1, 0, 0)
        for p in range(len(text)):
            for q in range(len(item)):
                k = 0
                while p + k < len(text) and q + k < len(item) and text[p + k] == item[q + k] and not used[p + k] and not covered[q + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, q)
        k, p, q = best
        if k < least:
            return sum(covered), tiles
        used[p : p + k], covered[q : q + k], tiles = [True] * k, [True] * k, tiles + 1


def test_tiling_against_brute_force(rng):
    for _ in range(150):
        item = [rng.randint(1, 30) for _ in range(rng.randint(5, 24))]
        text = [rng.randint(1, 30) for _ in range(4)]
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(len(item))
            text += item[a : a + rng.randint(3, 14)] + [rng.randint(1, 30) for _ in range(rng.randint(0, 3))]
        covered, tiles = D.tile(np.array(text, np.uint64), np.array(item, np.uint64), 4)
        expected = brute_tile(text, item, 4)
        # Equal matches may be taken in another order; what they cover hardly differs, long ones never do.
        assert abs(covered - expected[0]) <= 4 and (covered > 0) == (expected[0] > 0), (text, item)


def test_leaks_whole_reordered_and_partial(spark, docs_of, rng):
    item = words(rng, 40)
    half = " ".join(item[20:]) + " x y " + " ".join(item[:20])
    texts = [
        " ".join(words(rng, 50) + item + words(rng, 50)), "Intro: " + half.upper() + "!", " ".join(item[:12]), " ".join(item[:24]),
        None, "", " ".join(words(rng, 30000) + item), " ".join(words(rng, 200)),
    ]
    items = spark.createDataFrame([(7, ", ".join(item)), (7, ", ".join(item)), (8, None), (9, ""), (10, "ten words"), (None, "a b c d e f")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in D.leaks(docs_of(texts), items).collect()}
    assert set(found) == {(0, 7), (1, 7), (3, 7), (6, 7)}
    assert found[0, 7].coverage == 1.0 and found[1, 7].coverage == 1.0 and found[1, 7].n_tiles == 2 and found[3, 7].n_covered == 24
    clean = D.without_leaks(docs_of(texts).withColumnRenamed("source", "overlaps"), items)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 4, 5, 7] and "overlaps" in clean.columns


def test_a_large_benchmark_is_joined(spark, docs_of, rng):
    items = [(i, " ".join(words(rng, 12))) for i in range(6)]
    texts = [" ".join(words(rng, 5)) + " " + " ".join(t for _, t in rng.sample(items, k)) for k in (0, 1, 2, 3)] + [None, ""]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        {r.doc_id: sorted(map(tuple, r.overlaps)) for r in D.overlaps(docs_of(texts), bench, most_items=most).select("doc_id", "overlaps").collect()}
        for most in (100, 0)
    ]
    assert rows[0] == rows[1] and len(rows[0][3]) == 3
    assert D.leaks(docs_of([]), bench).count() == 0 and D.leaks(docs_of(texts), bench.limit(0)).count() == 0


def test_both_paths_agree_on_null_and_repeated_ids(spark, rng):
    one, other = " ".join(words(rng, 12)), " ".join(words(rng, 14))
    bench = spark.createDataFrame([(1, one), (1, other), (1, one), (2, other), (None, one)], "item_id long, text string")
    rows = [(None, "a " + one), (None, "b " + other), (5, "c " + one), (5, "c " + one), (5, "d " + other), (6, None), (None, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {"a " + one: [1], "b " + other: [1, 2], "c " + one: [1], "d " + other: [1, 2], "nothing": [], None: []}
    for most in (100, 0):
        found = D.overlaps(docs, bench, most_items=most).collect()
        assert len(found) == len(rows)
        assert all([o.item_id for o in r.overlaps if o.n_covered >= 12] == expected[r.text] for r in found), most


def test_words_are_lowered_and_split():
    found, first = D.tokens(pa.array(["The CAT's-hat", "the cat s hat", "É", "é"]))
    assert found[:4].tolist() == found[4:8].tolist() and first.tolist() == [0, 4, 8, 9, 10] and found[8] == found[9]


def every_leak(rows, items, coverage):
    """(text, item_id) of all leaks by tiling every text with every item."""
    out = []
    for text in rows:
        (words_of, (_, n)) = D.tokens(pa.array([text]))
        for i, item in items:
            wanted, (_, m) = D.tokens(pa.array([item]))
            if m and brute_tile(words_of.tolist(), wanted.tolist(), min(D.SEED, m))[0] >= coverage * m:
                out.append((text, i))
    return sorted(out)


def test_whole_query_against_brute_force(spark, rng):
    common = " ".join(words(rng, 6))  # a run that most items and texts share
    items = [(i, " ".join(words(rng, rng.randint(1, 20), 40)) + (" " + common if i % 3 else "")) for i in range(40)] + [(40, ""), (41, "w1 w2")]
    texts = []
    for _ in range(60):
        text = words(rng, rng.randint(0, 10), 40)
        for _, item in rng.sample(items, rng.randint(0, 3)):
            part = item.split()
            text += rng.choice([part, part[: len(part) // 2 + 1], part[len(part) // 2 :] + part[: len(part) // 2]]) + words(rng, 2)
        texts.append(" ".join(text + rng.choice([[], common.split()])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(t, "x") for t in texts], "text string, seed string").selectExpr("cast(null as long) as doc_id", "text", "seed")
    for coverage in (0.5, 0.9):
        expected = every_leak(texts, items, coverage)
        for most in (100, 0):
            found = D.overlaps(docs, bench, least=coverage, most_items=most).collect()
            assert sorted((r.text, o.item_id) for r in found for o in r.overlaps) == expected, (coverage, most)
            assert len(found) == len(texts)
