import random
import time

import pytest
from pyspark.sql import functions as F

from garim.functions import spans as S
from garim.operators import masking
from garim.operators.detectors import detect


def some(rng, n, length, widest):
    out = []
    for _ in range(n):
        at = rng.randrange(length)
        out.append((f"L{rng.randrange(3)}", "x", at, at + rng.randrange(1, widest), rng.randrange(1, 6), rng.choice([0.5, 0.9, 1.0]), rng.randrange(4)))
    return out


def greedy(spans):
    kept = []
    for x in spans:
        if not any(k[2] < x[3] and x[2] < k[3] for k in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: (x[2], x[3]))


def by_priority(spans):
    return sorted(spans, key=lambda x: (-x[4], -x[5], x[2] - x[3], x[2], x[6], x))


def runs(spans):
    out = []
    for start, end in sorted((x[2], x[3]) for x in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def test_overlaps_as_by_definition(spark):
    rng = random.Random(3)
    # Few and many spans, apart and in one run; some in the same place.
    sets = [some(rng, rng.randrange(12), 30, 8) for _ in range(200)] + [some(rng, 200, 400, 9) for _ in range(10)] + [some(rng, 300, 300, 3) for _ in range(5)]
    sets += [[("A", "x", i * 6, i * 6 + 9, 3, 1.0, 0) for i in range(1000)], [("A", "x", 5, 9, 3, 1.0, 0)] * 70]
    text = "".join(chr(97 + i % 26) if i % 7 else "한" for i in range(7000))
    df = spark.createDataFrame(list(enumerate(sets)), f"i int, spans array<{S.SPAN}>").withColumn("t", F.lit(text))
    spliced = S.splice(F.col("t"), S.resolve(F.col("spans")), lambda s: F.concat(F.lit("<"), s["label"], F.lit(">")))
    for row in df.select("i", S.resolve(F.col("spans")).alias("a"), S.first_come(F.col("spans")).alias("b"), S.merged(F.col("spans")).alias("c"), spliced.alias("d")).collect():
        spans = sets[row.i]
        best = greedy(by_priority(spans))
        assert [tuple(x) for x in row.a] == best
        assert [tuple(x) for x in row.b] == greedy(spans)
        assert [tuple(x) for x in row.c] == runs(spans)
        out, at = "", 0
        for x in best:
            out, at = out + text[at : x[2]] + f"<{x[0]}>", x[3]
        assert row.d == out + text[at:]


def test_null_and_empty(spark):
    df = spark.createDataFrame([(None, None), ("", []), ("ab", [])], f"t string, spans array<{S.SPAN}>")
    found = df.select(S.resolve(F.col("spans")).alias("a"), S.merged(F.col("spans")).alias("b"), S.splice(F.col("t"), F.col("spans"), lambda s: F.lit("x")).alias("c"), S.find_all("t", "b").alias("d")).collect()
    assert [r.c for r in found] == [None, "", "ab"] and [r.a for r in found] == [[], [], []]
    assert [len(r.d) for r in found] == [0, 0, 1]


def taken(query):
    query.collect()
    times = []
    for _ in range(3):
        began = time.perf_counter()
        query.collect()
        times.append(time.perf_counter() - began)
    return min(times)


@pytest.mark.parametrize("kind", ["addresses", "chain"])
def test_four_times_the_spans_take_less_than_eight_times_as_long(spark, kind):
    def query(n):
        if kind == "chain":
            df = spark.createDataFrame([([("A", "x", i * 6, i * 6 + 9, 3, 1.0, 0) for i in range(n)],)], f"spans array<{S.SPAN}>")
            return df.select(F.size(S.resolve(F.col("spans"))))
        df = spark.createDataFrame([(1, " ".join(f"user{i}@mail{i % 7}.com" for i in range(n)))], "doc_id long, text string")
        return masking.mask_text(masking.with_actions(detect(df, include=["EMAIL"]), "STRICT"), "redact").select(F.length("text_out"))

    assert taken(query(16000)) < 8 * taken(query(4000))


def test_a_text_is_cut_as_split_does_without_compiling_its_pattern(spark):
    """Ten thousand texts and a pattern of 60,000 characters: compiled for each text, they took minutes."""
    words = [f"w{i}x" for i in range(10_000)]
    pattern = "|".join(words)
    texts = ["", "w1x", "aw1xw2xb", "w3x￿ w4x\n", None, "￿", "none"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", S.pieces(F.col("text"), pattern).alias("mine"), F.split("text", pattern, -1).alias("spark")).collect()
    assert [r.mine for r in rows] == [r.spark for r in rows]
    many = spark.range(10_000).select(F.concat(F.lit("a w1x "), "id").alias("text")).select(F.size(S.pieces(F.col("text"), pattern)).alias("n"), S.find_all("text", pattern).alias("s"))
    began = time.time()
    assert many.where("n = 2 and s[0].start = 2 and size(s) = 1").count() == 10_000
    assert time.time() - began < 60
