import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from garim.llm import chunks
from garim.llm import token_files as M

PATH = public_tokenizers.path("word_bpe_49k.json")
POOL = ["a", "à", "À", "Σ", "σς", "İ", "ß", "'s", "'LL", "ﬁ", "²", "ª", "µ", "×", "٣", "7", " ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", "　", "é", "é", "́", "한글", "漢字", "😀", "<|endoftext|>", "<|", "|>", "!?", "the", "Tokenizer", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_pieces_give_the_ids_of_the_whole(library, rng, monkeypatch):
    monkeypatch.setattr(chunks, "REMEMBERED", 500)
    texts = ["", " ", None, "x" * 5000, *("".join(rng.choice(POOL) for _ in range(rng.randint(0, 12))) for _ in range(5000))]
    for start in range(0, len(texts), 100):
        batch = texts[start : start + 100]
        ids, bounds = M.encode_batch(pa.array(batch, pa.string()), PATH)
        for i, text in enumerate(batch):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_sliced_array(library):
    ids, bounds = M.encode_batch(pa.array(["no", "one two", "three"]).slice(1), PATH)
    assert ids[bounds[0] : bounds[1]].tolist() == library.encode("one two", add_special_tokens=False).ids and len(bounds) == 3


def expected(rows, library):
    out, at = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_whole_query(spark, docs_of, library):
    texts = ["One two", None, "", "naïve Ünïcode 123", "One two", "<|endoftext|> x", *(f"doc {i} words" for i in range(300)), "long word " * 40000]
    df = docs_of(texts).withColumn("part", F.lit(1)).withColumn("start", F.lit("x")).repartition(7)
    found = sorted(tuple(r) for r in M.op12(df, PATH).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert found == expected(list(enumerate(texts)), library)


def test_null_and_repeated_keys(spark, library):
    rows = [(None, "a"), (3, "c"), (1, "b"), (3, "c"), (1, "b")]
    found = M.op12(spark.createDataFrame(rows, "doc_id long, text string"), PATH).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted((tuple(r) for r in found), key=lambda r: r[1]) == expected([(None, "a"), (1, "b"), (1, "b"), (3, "c"), (3, "c")], library)
    assert M.op12(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_files_have_indexes_and_readers_prune(spark, docs_of, tmp_path, library):
    path = str(tmp_path / "files")
    df = docs_of([f"text number {i}" for i in range(5000)]).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    M.write(df, path, PATH)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = M.index(spark, path).orderBy("part").collect()
    assert len(parts) > 1 and all(a.last_id < b.first_id and a.start + a.n_tokens == b.start for a, b in zip(parts, parts[1:], strict=False))
    some = M.documents(spark, path, [17, 4321, 99999])
    want = {r[0]: r for r in expected([(i, f"text number {i}") for i in range(5000)], library)}
    assert {(r.doc_id, r.start, r.n_tokens) for r in some.collect()} == {want[17][:3], want[4321][:3]}
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "In(doc_id" in plan.replace("`", "")
    assert M.documents(spark, path, []).count() == 0

    orc = spark._jvm.org.apache.orc
    name = next(f for f in spark.read.orc(f"{path}/parts").inputFiles())
    reader = orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(name), orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    assert reader.getRowIndexStride() == M.STRIDE
    stripe = reader.rows().readStripeFooter(reader.getStripes().get(0))
    kinds = {stripe.getStreams(i).getKind().toString() for i in range(stripe.getStreamsCount())}
    assert "BLOOM_FILTER_UTF8" in kinds and "ROW_INDEX" in kinds
    assert "DIRECT_V2" in {stripe.getColumns(i).getKind().toString() for i in range(stripe.getColumnsCount())}


def test_texts_are_cut_before_words_are_told_apart():
    """One look-up for a word, however it is written and whatever stands beside it."""
    texts = ["Ab,ab\tAB ÀÖ×öß µ§", None, "", "It's A<|b Ağ x<y"]
    assert M._pieces(pa.array(["left out", *texts])[1:]).to_pylist() == [
        ["ab", ",", "ab", "ab", "àö", "×", "öß", "µ", "§"], [], [], ["It's", "A<|b", "Ağ", "x", "<", "y"]
    ]
