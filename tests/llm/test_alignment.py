import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from garim.llm import alignment as M

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
POOL = ["a", "Hello", "don't", "'s", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", "　", "é", "é", "▁", "<s>", "<|endoftext|>", "한글", "漢字", "😀", "’", "…", "123", "4567", "\x00", "!?", "thé", "<0x41>"]
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def groups_of(text, sides):
    """Groups of ids, by walking over bytes."""
    if not text:
        return []
    a, b = sides
    letters, whole = M._byte_level(), b" " + text.encode()
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
        return []
    out, x, y, at_x, at_y = [], [], [], 0, 0
    while left or right:
        if at_x <= at_y:
            i, token = left.pop(0)
            x, at_x = [*x, i], at_x + len(token)
        else:
            i, token = right.pop(0)
            y, at_y = [*y, i], at_y + len(token)
        if at_x == at_y:
            out.append((x, y))
            x, y = [], []
    return out


def by_definition(texts, sides):
    docs = [groups_of(t, sides) for t in texts]
    links = [[(i, j) for x, y in d for i in x for j in y] for d in docs]
    count = Counter(p for ls in links for p in set(ls))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(n, best.get(i, 0))
    out = []
    for k, (d, ls) in enumerate(zip(docs, links, strict=True)):
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d)
        out.append((k, sum(len(x) for x, _ in d), sum(len(y) for _, y in d), len(d), len(ls), sum(count[p] == best[p[0]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(told.encode()).hexdigest() if d else ""))
    return out


def test_stretches_give_the_tokens_of_the_whole(sides, rng):
    both = M.pair(A, B)
    texts = ["", " ", None, "x" * 3000, " lead", "trail ", "a  b", *("".join(rng.choice(POOL) for _ in range(rng.randint(0, 9))) for _ in range(3000))]
    for start in range(0, len(texts), 200):
        batch = texts[start : start + 200]
        found = M.align_texts(pa.array(batch, pa.string()), both)[0]
        for i, text in enumerate(batch):
            groups = groups_of(text, sides)
            told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            assert found["groups"][i].as_py() == told, repr(text)
            assert found["n_links"][i].as_py() == sum(len(x) * len(y) for x, y in groups)


def test_whole_query(spark, docs_of, sides, rng, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(M, "AT_ONCE", 1500)
    texts = ["The cat sat. The cat's hat!", None, "", " ", "a▁b", "한글 漢字", "The cat sat.", "long text " * 3000, *("".join(rng.choice(POOL) for _ in range(rng.randint(0, 9))) for _ in range(200))]
    df = docs_of(texts).withColumn("block", F.lit(1)).withColumn("pairs", F.lit("x")).repartition(3)
    found = sorted(tuple(r) for r in M.op13(df, A, B).select(*COLUMNS).collect())
    assert found == by_definition(texts, sides)


def test_large_groups_are_counted_whole(monkeypatch, sides):
    both, text = M.pair(A, B), "zzzzqqq한글x漢字" * 40
    plain = M.align_texts(pa.array([text, "one two"]), both)
    monkeypatch.setattr(M, "SMALL_GROUP", 0)
    reduced = M.align_texts(pa.array([text, "one two"]), both)
    assert plain[0] == reduced[0] and all((x == y).all() for x, y in zip(plain[1:], reduced[1:], strict=True))


def test_products_of_a_group_that_never_closes():
    import numpy as np

    a, b = np.array([1, 2] * 500, np.int32), np.array([7, 8, 9] * 300, np.int32)
    group, pairs, times = M.products(a, np.array([0, 1000]), b, np.array([0, 900]))
    assert len(pairs) == 6 and times.sum() == 900_000 and set(group) == {0}


def test_null_and_repeated_keys_and_empty_table(spark):
    rows = [(None, "one two"), (1, "one two"), (1, "one two"), (2, None)]
    found = M.op13(spark.createDataFrame(rows, "doc_id long, text string"), A, B).select(*COLUMNS).collect()
    assert len(found) == 4 and {r.count_sum for r in found} == {0, 6}
    assert M.op13(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
