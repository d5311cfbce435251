import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import DOCUMENTS, words
from tests.llm.test_jaccard import similar


@pytest.fixture
def folder(spark, tmp_path, rng):
    item = " ".join(words(rng, 30))
    good = [" ".join(words(rng, 90)) + "." for _ in range(12)]
    texts = {i: t for i, t in enumerate(good)}
    texts |= {20: good[0], 21: good[1] + " end", 22: "too short", 23: None, 24: " ".join(words(rng, 60)) + " " + item}
    texts |= {25: " ".join(words(rng, 60)) + ' password = "hunter2222" tail'}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), texts


def test_stages_take_effect(spark, folder):
    path, texts = folder
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    near = any(similar(texts[21], texts[i]) for i in range(12))
    assert near and set(found) == {*range(12), 25}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, row in found.items():
        text = (texts[i]).replace('password = "hunter2222', "[secret]")
        assert list(row.token_ids) == library.encode(text, add_special_tokens=False).ids and row.n_tokens == len(row.token_ids)


def test_each_stage_on_an_empty_table(spark, folder):
    path, _ = folder
    docs = spark.createDataFrame([], DOCUMENTS)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "encoding"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0
