import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from garim.llm import manifest as M

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def by_definition(rows):
    """Rows of op11, each tree built level by level."""

    def leaf(doc_id, source, lang, n_chars, text):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    def tree(level):
        """(root, for each leaf its runs and places)"""
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            runs = [level[i : i + 8] for i in range(0, len(level), 8)]
            for leaf_path, i in zip(paths, at, strict=True):
                leaf_path.append((runs[i // 8], i % 8))
            at, level = [i // 8 for i in at], [H(*r) for r in runs]
        return level[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1]))) for g in langs}
    made = {g: tree([leaf(r[0], r[3], r[2], r[4], r[1]) for r in groups[g]]) for g in langs}
    root, tops = tree([made[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops, strict=True):
        subroot, paths = made[g]
        for (doc_id, text, lang, source, n_chars), path in zip(groups[g], paths, strict=True):
            full = path + top
            siblings = H(*(x for run, i in full for x in run[:i] + run[i + 1 :]))
            chosen = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
            changed = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if chosen and text is not None else text
            node = leaf(doc_id, source, lang, n_chars, changed)
            for run, i in full:
                node = H(*run[:i], node, *run[i + 1 :])
            out.append((doc_id, leaf(doc_id, source, lang, n_chars, text), subroot, root, siblings, node, node == root))
    return sorted(out, key=str)


def found(df):
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in columns) for r in M.op11(df).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 100, 500, 511, 512])
def test_traversal_gives_every_path(n):
    leaves = [str(i).encode() for i in range(n)]
    levels = M.depth(n)
    steps = list(M.traversal(leaves, levels))
    assert len(steps) == n
    root = M.block_root(leaves, levels)
    for leaf, path in zip(leaves, steps, strict=True):
        for left, right in path:
            leaf = M.digest([left, leaf, right])
        assert leaf == root


def test_traversal_of_a_block_below_others():
    # A last block rises as many levels as the others, even with one leaf.
    assert M.block_root([b"x"], 3) == M.digest([M.digest([M.digest([b"x"])])])
    assert next(M.traversal([b"x"], 3)) == [(b"", b"")] * 3


def test_growing_run_holds_partial_runs_alone():
    leaves = [str(i).encode() for i in range(512)]
    run = M.Growing(leaves, 2, 0)
    for _ in leaves:
        run.grow()
        assert len(run.runs[0]) < 8 and len(run.runs[1]) < 8
    assert len(run.nodes()) == 8


def test_same_as_definition(spark):
    rows = [(i, f"Text {i} É", ("en", "de", None, "")[min(i % 7, 3)], None if i % 5 == 0 else "S", i) for i in range(700)]
    rows += [(700 + i, "A hot one", "en", "s", None) for i in range(600)]
    rows += [(5, "tie B", "en", "s", 1), (5, "tie A", "en", "s", 1), (5, "tie A", "en", "s", 1), (None, "Null Key", "en", None, None), (None, None, None, None, None), (9001, "", "zz", "", 0), (9002, "LONG é " * 50000, "fr", "s", 7)]
    df = spark.createDataFrame(rows, ROWS).withColumn("proof", F.lit(1)).withColumn("root", F.lit("x")).withColumn("name", F.lit(2)).withColumn("pos", F.lit(3))
    assert found(df.repartition(5)) == by_definition(rows)


def test_small_tables(spark):
    assert found(spark.createDataFrame([], ROWS)) == []
    one = [(1, "Only", "en", "s", 4)]
    assert found(spark.createDataFrame(one, ROWS)) == by_definition(one)
    many = [(i, "x", f"l{i:02}", "s", 1) for i in range(20)]
    assert found(spark.createDataFrame(many, ROWS)) == by_definition(many)


def test_proofs_check_out(spark):
    rows = [(i, f"t{i}", "en", "s", 2) for i in range(600)]
    df = spark.createDataFrame(rows, ROWS)
    proved = M.manifest(df.select("doc_id", "lang", M.leaf(*[F.col(c) for c in M.FIELDS]).alias("leaf")))
    assert proved.where(M.folded(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 600
    assert proved.where(M.folded(F.sha2(F.lit("other").cast("binary"), 256), F.col("proof")) == F.col("root")).count() == 0
    assert {len(r.proof) for r in proved.select("proof").collect()} == {4}


def test_same_rows_as_sql(spark, tmp_path):
    rows = [(i, f"Text {i} Éa", ("en", "de", None)[i % 3], None, i) for i in range(300)]
    df = spark.createDataFrame(rows, ROWS)
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    sql = con.execute(f"select doc_id, leaf, subroot, root, proof_sha256, folded_root, verified from ({M.ORACLE})").fetchall()
    assert sorted(sql, key=str) == found(df)
