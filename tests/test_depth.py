import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from garim.functions.ordered import with_running
from garim.operators import classifier, evaluation, guards, sequences, vault
from garim.plans import catalog, depth

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "labels", "lineitem", "customer", "nation", "region", "documents", "benchmark")


@pytest.mark.parametrize("name", sorted(depth.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    expected = con.sql(depth.ORACLES[name])
    found = depth.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(expected.columns)
    columns = sorted(found.columns)
    rows = lambda every: sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in every)
    want = expected.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert want and rows(found.select(*columns).collect()) == rows(want)


def test_running_sums_of_groups_and_ties(spark):
    rows = [("a", i % 7, i) for i in range(500)] + [(None, 1, 5), (None, 0, 2), ("b", None, 1)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(5)
    found = with_running(df, ["k"], {"before": F.col("v"), "rank": F.lit(1)}, ["g"]).collect()
    assert len(found) == len(rows)
    for g in ("a", None, "b"):
        own = sorted((r for r in found if r.g == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own)))
        keys = [(r.k is not None, r.k or 0) for r in own]
        assert keys == sorted(keys)
        total = 0
        for r in own:
            assert r.before == total
            total += r.v
    assert with_running(df.limit(0), ["k"], {"before": F.col("v")}).count() == 0


def test_auc_by_all_pairs(spark):
    rng = np.random.default_rng(4)
    score, label = rng.integers(0, 20, 300) / 20, rng.integers(0, 2, 300)
    rows = [(float(s), int(y)) for s, y in zip(score, label, strict=True)] + [(None, 1), (0.5, None), (0.1, 7)]
    row = evaluation.auc(spark.createDataFrame(rows, "score double, label int")).first()
    pos, neg = score[label == 1], score[label == 0]
    want = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
    assert row.auc == pytest.approx(want) and (row.n_positive, row.n_negative) == (len(pos), len(neg))
    assert evaluation.auc(spark.createDataFrame([(0.5, 1)], "score double, label int")).first().auc is None


def test_classifier_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    docs = docs.select("doc_id", "text", F.col("quality").alias("label"))
    model = classifier.fit(docs.where("doc_id % 4 <> 0").union(spark.createDataFrame([(-1, None, 0)], "doc_id long, text string, label int")))
    scored = classifier.scores(model, docs.where("doc_id % 4 = 0"))
    assert evaluation.auc(scored).first().auc > 0.8
    assert classifier.scores(model, spark.createDataFrame([(None,)], "text string")).first().score is not None


def common_run(text, context):
    best = (0, -1, -1)
    for i in range(len(text)):
        for j in range(len(context)):
            n = 0
            while i + n < len(text) and j + n < len(context) and text[i + n] == context[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    return best


def test_longest_common_runs(spark):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("ab가😀"), n))
    pairs = [(word(rng.integers(0, 30)), word(rng.integers(0, 30))) for _ in range(150)] + [("aaaa", "aa"), ("", "a"), ("x", "y")]
    for text, context in pairs:
        n, i, j = guards._common_run(text, context)
        assert n == common_run(text, context)[0] and text[i : i + n] == context[j : j + n] if n else (i, j) == (-1, -1)
    df = spark.createDataFrame([(None, "a"), ("a", None), ("ab", "xab")], "t string, c string")
    assert [tuple(r.r) for r in df.select(guards.common_run("t", "c").alias("r")).collect()] == [(0, -1, -1), (0, -1, -1), (2, 0, 1)]


def test_common_run_of_a_megabyte():
    import time

    rng = np.random.default_rng(1)
    text, context = ("".join(map(chr, rng.integers(97, 123, n))) for n in (1_000_000, 100_000))
    text = text[:500_000] + context[70_000:70_500] + text[500_000:]
    began = time.perf_counter()
    n, i, j = guards._common_run(text, context)
    assert n >= 500 and text[i : i + n] == context[j : j + n] and time.perf_counter() - began < 30


def test_vault_merges_and_broken_logs(spark, tmp_path):
    stored = spark.createDataFrame([("P", "x", "<P_7>"), ("Q", "y", "<Q_1>")], "label string, original string, token string")
    seen = spark.createDataFrame([("P", "x", 5), ("P", "b", 3), ("P", "a", 4), ("P", "a", 1), (None, "z", 1), ("R", None, 1), ("R", "r", 2)], "label string, original string, at int")
    found = {(r.label, r.original): r.token for r in vault.merged(stored, seen, ["at"]).collect()}
    assert found == {("P", "x"): "<P_7>", ("Q", "y"): "<Q_1>", ("P", "a"): "<P_8>", ("P", "b"): "<P_9>", ("R", "r"): "<R_1>"}
    (tmp_path / "log").mkdir()
    line = '{"ts": "2024-01-0%d 00:00:00", "action": "%s", "token": "<P_1>", "label": "P", "actor": "me"}\n'
    (tmp_path / "log" / "a.json").write_text(line % (2, "mask") + "\n{broken\n" + line % (1, "store") + line % (2, "mask"))
    events = vault.read_audit(spark, str(tmp_path / "log"))
    once = vault.replayed(events)
    row = vault.replayed(events, once).first()
    assert (row.last_action, row.n_events, row.actors) == ("mask", 2, ["me"]) and once.first().n_events == 2


def test_bioes_and_chunks(spark):
    tags = ["B-A", "I-A", "E-A", "S-A", "O", "E-B", "I-B", "B-A", "S-A"]
    df = spark.createDataFrame([(1, i, chr(97 + i), t, 1.0) for i, t in enumerate(tags)], "doc_id long, pos long, ch string, tag string, score double")
    found = sorted((r.start, r.end, r.label) for r in sequences.bioes_spans(df).collect())
    assert found == [(0, 3, "A"), (3, 4, "A"), (5, 6, "B"), (6, 7, "B"), (7, 8, "A"), (8, 9, "A")]
    dealt = sequences.chunks(df, 4, 2)
    assert dealt.where("core").count() == 9 and dealt.count() > 9
    assert sorted(r.tag for r in sequences.joined_chunks(dealt).collect()) == sorted(tags)
    with pytest.raises(ValueError):
        sequences.chunks(df, 2, 2)


def test_islands_of_places_that_come_twice(spark, tmp_path):
    """The row that comes first in the files counts, whichever task ends first: Spark reads the longest file first."""
    row = "l_orderkey long, l_linenumber int, l_returnflag string"
    for name, rows in (("a", [(1, 1, "A")]), ("b", [(1, 1, "R"), (1, 2, "R")] + [(k, 1, "N") for k in range(2, 20000)])):
        spark.createDataFrame(rows, row).coalesce(1).write.parquet(str(tmp_path / name))
    (tmp_path / "lineitem.parquet").mkdir()
    for name in "ab":
        next((tmp_path / name).glob("part-*")).rename(tmp_path / "lineitem.parquet" / f"{name}.parquet")
    for query in (catalog.bio_islands, depth.chunked_islands):
        found = query(spark, str(tmp_path)).where("doc_id = 1").select("label", "start", "end", "n").collect()
        assert sorted(map(tuple, found)) == [("A", 1, 2, 1), ("R", 2, 3, 1)]
