import numpy as np
import pytest
import xxhash

from garim.llm import simhash
from garim.llm.components import connected_components
from tests.llm.conftest import words


def brute_print(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(prints):
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_against_brute_force(spark, docs_of, rng):
    base = [words(rng, n) for n in (300, 200, 120, 40)]
    texts = [None, "", " \t ", "One", "one two THREE", "é É", "x " * 20000]
    for b in base:
        for k in range(12):
            copy = list(b)
            for _ in range(k // 2):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(9)}"
            texts.append((" " if k % 2 else "\n").join(copy))
    rng.shuffle(texts)
    found = {r.doc_id: r for r in simhash.near_duplicates(docs_of(texts)).collect()}
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in found.items()} == prints
    assert {i: r.component_id for i, r in found.items()} == brute_components(prints)


@pytest.mark.parametrize("bucket", [1 << 8, 1 << 13, 1 << 21])
def test_links_lose_no_pair(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = {0, (1 << 64) - 1}
    for s in seeds.tolist():
        for k in range(25):
            flips = rng.choice(64, int(rng.integers(0, 7)), replace=False)
            prints.add(s ^ sum(1 << int(f) for f in flips))
    prints = sorted(prints)
    rows = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    found = connected_components(simhash.links(spark.createDataFrame(rows, "fp long"))).collect()
    expected = brute_components(dict(enumerate(prints)))
    groups = {}
    for i, p in enumerate(prints):
        groups.setdefault(expected[i], set()).add(int(np.uint64(p).astype(np.int64)))
    ours = {}
    for r in found:
        ours.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, ours.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_chunked_search_is_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    prints = np.unique(rng.integers(0, 1 << 20, 60, dtype=np.uint64))
    whole = simhash._meet(prints, 0, 0, 2)
    monkeypatch.setattr(simhash, "AT_ONCE", 5000)
    parts = simhash._meet(prints, 0, 0, 2)
    stars = [simhash._stars(prints, *p).tolist() for p in (whole, parts)]
    assert stars[0] == stars[1]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[i] for i in range(61)}) == 1 and len({found[i] for i in range(100, 140)}) == 1
    assert found[200] == 200 and found[300] == found[301] and len(set(found.values())) == 4


def test_keep_one_and_empty(spark, docs_of):
    kept = simhash.keep_one(docs_of(["a b c d e", "x y z", "a b c d e", None, ""]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3]
    assert simhash.near_duplicates(docs_of([])).count() == 0
