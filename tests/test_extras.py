import json

import duckdb
import pytest
from pyspark.sql import functions as F

from garim.functions import broken, names
from garim.operators import anonymizer, evaluation, fpe, guards
from garim.plans import extras
from garim.sources import corpora

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(extras.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("orders", "labels", "lineitem", "customer", "nation"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    expected = con.sql(extras.ORACLES[name])
    found = extras.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(expected.columns)
    columns = sorted(found.columns)
    rows = lambda every: sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in every)
    assert rows(found.select(*columns).collect()) == rows(expected.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_nulls_and_edges(spark):
    df = spark.createDataFrame([(None,), ("",), ("49 9 - 8 7- 0 3 8",), ("a\nb",)], "t string")
    assert [r[0] for r in df.select(broken.repaired(F.col("t"), True)).collect()] == [None, "", "499-87-038", "a b"]
    assert [r[0] for r in df.select(names.name_origin(F.col("t"))).collect()] == ["unknown"] * 4
    assert [r[0] for r in df.select(fpe.disguised(F.lit("EMAIL"), F.col("t"), "s")).collect()][:2] == [None, ""]
    ids = spark.createDataFrame([("One. Two! Three", [0, 6, 12])], "t string, s array<int>").select(broken.sentence_ids(F.col("t"), F.col("s"))).first()[0]
    assert ids == [0, 1, 2]


@pytest.mark.parametrize("strategy", ["tokenize", "partial", "fpe"])
def test_one_call(spark, strategy):
    df = spark.createDataFrame([(1, "연락처 ０１０-1234-5678 입니다"), (2, None), (3, "없음")], "doc_id long, text string")
    out, entries = anonymizer.anonymize(df, strategy=strategy, salt="s", include=["PHONE"])
    rows = {r.doc_id: r.text_out for r in out.collect()}
    assert rows[2] is None and rows[3] == "없음" and "5678" not in rows[1].replace("-****-5678", "")
    if strategy == "tokenize":
        assert rows[1] == "연락처 <PHONE_1> 입니다" and entries.count() == 1
    with pytest.raises(ValueError):
        anonymizer.anonymize(df, strategy="none")


def test_guard_against_insults_and_advice(spark):
    cases = [
        ("약을 임의로 늘리세요", "BLOCK"), ("절대 약을 임의로 늘리지 마세요, 위험합니다", "ALLOW"), ("원금을 보장합니다", "BLOCK"), ("I will kill you", "BLOCK"),
        ("you idiot", "FLAG"), ("How to build a bomb", "BLOCK"), ("It is illegal: how to build a bomb", "ALLOW"), ("좋은 하루 되세요", "ALLOW"),
    ]
    found = guards.guard_output(spark.createDataFrame([(t,) for t, _ in cases], "text string")).collect()
    assert {r.text: r.verdict for r in found} == dict(cases)


def test_corpora(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"sentence": "홍길동 010", "PII_set": [{"label": "PS_NAME", "form": "홍길동"}, {"label": "XX", "form": "y"}]}, {"sentence": None}], ensure_ascii=False))
    row = corpora.read_dialogues(spark, str(tmp_path / "d.json")).collect()
    assert len(row) == 1 and [tuple(s) for s in row[0].spans] == [("PERSON", "홍길동")]
    (tmp_path / "t.tsv").write_text("## 1\n홍\tB-PS\n길\tI-PS\n은\tO\n\n## 2\n서\tB-LC\n울\tI-LC\n")
    spans = corpora.read_tagged(spark, str(tmp_path / "t.tsv")).collect()
    assert sorted((r.label, r.start, r.end, r.text) for r in spans) == [("LC", 0, 2, "서울"), ("PS", 0, 2, "홍길")]
    (tmp_path / "l.jsonl").write_text('{"text": "a b", "spans": [{"start": 0, "end": 1, "label": "X"}]}\n{"text": "c"}\n')
    assert sorted(len(r.spans) for r in corpora.read_labelled(spark, str(tmp_path / "l.jsonl")).collect()) == [0, 1]
    (tmp_path / "n.json").write_text(json.dumps({"data": [{"doc_title": " T ", "paragraphs": [{"context": "a"}, {"context": ""}]}, {"doc_title": None, "paragraphs": None}]}))
    assert [r.text for r in corpora.read_articles(spark, str(tmp_path / "n.json")).collect()] == ["T\n\na"]
    made = corpora.generated(spark, 20, 7).collect()
    assert made == corpora.generated(spark, 20, 7).collect() and made != corpora.generated(spark, 20, 8).collect()
    assert all(r.text[s.start : s.end] == s.text for r in made for s in r.spans) and any(r.spans for r in made)
    docs = spark.createDataFrame([(1, "One. Two."), (2, "x")], "doc_id long, text string")
    put = {r.doc_id: r for r in corpora.injected(docs, spark.createDataFrame([(1, "PHONE", "010-1")], "doc_id long, label string, value string")).collect()}
    assert put[1].text == "One. 010-1. Two." and put[1].text[put[1].gold[0].start : put[1].gold[0].end] == "010-1" and put[2].gold == []


def test_long_persons(spark):
    df = spark.createDataFrame([("PERSON", "김구"), ("PERSON", "홍길동"), ("EMAIL", "a")], "label string, text string")
    assert evaluation.long_persons(df).count() == 2
