import pytest

import corpus_pipeline
from garim.llm import jaccard
from tests.llm.conftest import DOCUMENTS, words


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return a == b or len(a & b) >= 0.8 * len(a | b)


def brute_force(texts):
    """Indices that stay: the first of each component of similar texts."""
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similar(texts[i], texts[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return sorted(set(root))


@pytest.mark.parametrize("small", [jaccard.SMALL, 2])
def test_same_as_brute_force(spark, docs_of, rng, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    texts = [" ".join(words(rng, 150)) for _ in range(12)]
    for base in texts[:12]:
        for changes in (1, 2, 3, 4, 5, 9, 20):
            w = base.split()
            for at in rng.sample(range(150), changes):
                w[at] = f"new{rng.randrange(1000)}"
            texts.append(" ".join(w))
    texts += [texts[0].upper().replace(" ", "  "), "a b c", "a b d", "A b c", "", None]
    found = corpus_pipeline.near_duplicates(spark, docs_of(texts), "")
    kept = brute_force(texts)
    assert 12 < len(kept) < len(texts) - 30
    assert sorted(r.doc_id for r in found.collect()) == kept


def test_nulls_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text), (1, text + " end"), (2, text), (1, text + " end"), (3, "other words here"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENTS)
    found = sorted((r.doc_id or 0, r.text or "") for r in jaccard.keep_one(docs).collect())
    assert found == [(0, ""), (0, text), (1, text + " end"), (1, text + " end"), (3, "other words here")]


def test_no_link_of_a_bucket_is_left_out(spark, rng, monkeypatch):
    """Texts of one SimHash or one bucket, whose first text or centre only some are like: the others' links stay."""
    monkeypatch.setattr(jaccard, "SMALL", 2)
    bases = [words(rng, 100, 5000) for _ in range(3)]
    texts = [" ".join(b[:98] + [f"x{k}", f"y{k}"]) for b in bases for k in range(4)]
    prints = jaccard.sketches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    one = jaccard.F.lit(1).cast("long")
    for alike in ({"sim": one, "bands": jaccard.F.array().cast("array<long>")}, {"bands": jaccard.F.array(one)}):
        table = jaccard.saved(prints.withColumns(alike), "alike")
        found = jaccard.simhash.components(table, linked=jaccard.links(table))
        of = {r.doc_id: r.component_id for r in table.join(found, "fp").collect()}
        assert of == {i: i - i % 4 for i in range(12)}


def test_rows_of_a_large_bucket_of_unlike_copies(spark, rng, monkeypatch):
    """Copies that are too far from their original, and those that another links to: all links, and rows far below the pairs."""
    base, texts = words(rng, 150, 100000), []
    for i in range(300):
        w = list(base)
        for at in rng.sample(range(150), rng.choice([2, 6, 10])):
            w[at] = f"x{i}-{at}"
        texts.append(" ".join(w))
    texts += [t + " at the end" for t in texts[::7]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = jaccard.F.lit(1).cast("long")
    table = jaccard.saved(jaccard.sketches(docs).withColumns({"sim": one, "bands": jaccard.F.array(one)}), "alike")
    sifted, of_pairs = [], jaccard._sifted
    monkeypatch.setattr(jaccard, "_sifted", lambda pairs, sigs: sifted.append(pairs.count()) or of_pairs(pairs, sigs))
    monkeypatch.setattr(jaccard, "BLOCK", 50)
    links = jaccard.links(table)
    named = jaccard.simhash.components(table, linked=links)
    assert sum(sifted) <= 5 * len(texts) and links.count() < 40 * len(texts)
    assert sorted(r.component_id for r in table.join(named, "fp").select("component_id").distinct().collect()) == brute_force(texts)
