import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from garim.functions import broken, normalize, offsets
from garim.functions import spans as S

POOL = ["가", "a", "é", "é", "̣́", "ȫ", "홍", "가", "ᆨ", "１", "٣", "①", "㈜", "ﬁ", "​", "\x00", "\x07", "—", "／", "²", "½", "9", "1́", "ͅ", "ｶﾞ", "㎡", "漢", "豈", "🄰", "\U0001d7d8", "༹", "क़", " ", "\n", "-", "l2", "O0", "한글", "q̣̇", "\U000f0001"]


def joins(base, ch):
    return unicodedata.combining(ch) > 0 or 0x1160 <= ord(ch) <= 0x11FF and 0x1100 <= ord(base) <= 0x11FF


def numbers(text):
    """Letters read as digits, token by token."""
    out, at = [], 0
    digits, dashes = dict(zip(normalize.LETTERS, normalize.DIGITS, strict=True)), "-" + "".join(map(chr, range(0x2010, 0x2016)))
    while at < len(text):
        if not (text[at].isascii() and text[at].isdigit() or text[at] in digits):
            out.append(text[at])
            at += 1
            continue
        end = at
        while end < len(text) and (text[end].isascii() and text[end].isdigit() or text[end] in digits or text[end] in dashes):
            end += 1
        token = text[at:end]
        if sum(c.isdigit() for c in token) >= 2 and any(c in digits for c in token):
            token = "".join(digits.get(c, c) for c in token)
        out.append(token)
        at = end
    return "".join(out)


def by_definition(text):
    """The text, and the place in the source of each of its characters."""
    if all(c in "\t\n\r" or " " <= c <= "~" or "가" <= c <= "힣" for c in text):
        return text, list(range(len(text)))
    source, text = text, numbers(text)
    out, places, at = [], [], 0
    while at < len(text):
        end = at + 1
        while end < len(text) and joins(text[at], text[end]):
            end += 1
        cluster = text[at:end]
        control = unicodedata.category(cluster[0]) == "Cc" and cluster[0] not in "\t\n\r"
        if not control and ord(cluster[0]) not in normalize.INVISIBLE:
            whole = normalize._FOLD.get(cluster) or unicodedata.normalize("NFKC", cluster)
            if not cluster[0].isalpha():
                whole = "".join(c for c in whole if not unicodedata.combining(c))
            for ch in "".join(map(normalize._folded, whole)):
                out.append(ch)
                places.append(at)
        at = end
    # A text that comes out as it was keeps its places.
    return "".join(out), list(range(len(text))) if "".join(out) == source else places


def states(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    df = normalize.with_normalized(df)
    every = F.transform(F.sequence(F.lit(0), F.length("normal.text") - 1), lambda p: F.struct(F.lit("").alias("label"), F.lit("").alias("text"), p.cast("int").alias("start"), (p + 1).cast("int").alias("end")))
    every = F.when(F.length("normal.text") > 0, every)
    return {r.i: r for r in df.select("i", "normal.text", offsets.to_source(every, F.col("normal"), F.col("text")).alias("back")).collect()}


def test_every_character_and_many_strings(spark):
    rng = random.Random(5)
    codes = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    texts = ["".join(x + "가" for x in codes[i : i + 500]) for i in range(0, len(codes), 500)]
    marks = [c for c in codes if unicodedata.combining(c)]
    halves = [chr(int(p, 16)) for c in codes for p in unicodedata.decomposition(c).split() if p and p[0] != "<"]
    texts += ["".join(rng.choice(POOL) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    texts += ["".join(rng.choice(rng.choice((marks, halves, ["a", "1", "가", "ᄀ"]))) for _ in range(rng.randint(1, 6))) for _ in range(4000)]
    found = states(spark, texts)
    for i, text in enumerate(texts):
        want, places = by_definition(text)
        assert found[i].text == want, ascii(text)
        if want:
            ends = [*places[1:], len(text)]
            assert [(s.start, s.end) for s in found[i].back] == list(zip(places, ends, strict=True)), ascii(text)


def test_plan_without_python_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "전화 ０１０—l234—5678")], "doc_id long, text string")
    found = normalize.detect_normalized(df, include=["PHONE"])
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    assert [[(s.text, s.start, s.end) for s in r.spans] for r in found.orderBy("doc_id").collect()] == [[], [], [("０１０—l234—5678", 3, 16)]]


def unbroken(text):
    """The repair of broken fields and lines, character by character, with places."""
    import re

    out, places = [], []
    fields = [(m.start(), m.end()) for m in re.finditer(broken.SPACED.replace("[0-9]", "[0-9]"), text)]
    inside = {i for a, z in fields for i in range(a, z) if text[i] == " "}
    kept = [(c, i) for i, c in enumerate(text) if i not in inside]
    joined = "".join(c for c, _ in kept)
    gone = {m.start() for m in re.finditer(broken.IN_WORD, joined)}
    spaces = {m.start() for m in re.finditer(broken.IN_NUMBER, joined)}
    for k, (c, i) in enumerate(kept):
        if k not in gone:
            out.append(" " if k in spaces else c)
            places.append(i)
    return "".join(out), places


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_then_normalisation_lead_back_to_the_source(spark, seed):
    rng = random.Random(seed)
    pool = ["가", "나\n다", "9 5 1 2 3 0 - 1 8 5", "49 9 - 8 7- 0 3 8", "\n", "1\n2", "a\n1", " ", "x", "①", "ｶﾞ", "​", "é"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 10))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    df = normalize.with_normalized(df, repair_lines=True)
    every = F.transform(F.sequence(F.lit(0), F.length("normal.text") - 1), lambda p: F.struct(F.lit("").alias("text"), p.cast("int").alias("start"), (p + 1).cast("int").alias("end")))
    rows = df.select("i", "normal.text", offsets.to_source(F.when(F.length("normal.text") > 0, every), F.col("normal"), F.col("text")).alias("back")).collect()
    for r in rows:
        whole, first = unbroken(texts[r.i])
        want, second = by_definition(whole)
        assert r.text == want, ascii(texts[r.i])
        if want:
            assert [s.start for s in r.back] == [first[p] for p in second]
            # The end lies behind the last character of what the repaired text has there.
            assert [s.end for s in r.back] == [first[p - 1] + 1 for p in [*second[1:], len(whole)]], ascii(texts[r.i])


def test_long_text_with_many_changes(spark):
    import time

    def taken(n):
        df = spark.createDataFrame([(1, "전화 ㈜010-1234-5678 " * n)], "doc_id long, text string")
        found = normalize.with_normalized(df).select(F.length("normal.text"), F.size(F.get("normal.maps", F.lit(0))["runs"]))
        row = found.first()
        assert row[0] == 20 * n and row[1] == 2 * n + 1
        times = []
        for _ in range(3):
            began = time.perf_counter()
            found.collect()
            times.append(time.perf_counter() - began)
        return min(times)

    assert taken(8000) < 8 * taken(2000)
    assert S.SPAN


def test_boxes_and_broken_lines_are_one_map_of_few_runs(spark):
    """A run for each box, and a map for lines and another for fields, made up most of the time on such texts."""
    texts = ["전화 번\n호 0 1 0 - 1 2 3 4 - 5 6 7 8 끝", "49 9 - 8 7- 0 3 8 ￿ 0 1 0 - 1 2 3 4 - 5", "￿", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    df = normalize.with_normalized(df, repair_lines=True)
    rows = {r.i: r for r in df.select("i", "normal").collect()}
    first = rows[0].normal
    assert first.text == "전화 번호 010-1234-5678 끝" and len(first.maps) == 1
    assert [(r.at, r.source, r.step) for r in first.maps[0].runs] == [(0, 0, 1), (4, 5, 1), (6, 7, 2), (19, 32, 1)]
    assert rows[1].normal.text == "499-87-038 ￿ 010-1234-5" and rows[2].normal.text == "￿" and rows[3].normal.text == ""
    found = normalize.detect_normalized(df.select("i", "text"), repair_lines=True, include=["PHONE"]).where("i = 0").first().spans
    assert [(s.text, s.start, s.end) for s in found] == [("0 1 0 - 1 2 3 4 - 5 6 7 8", 7, 32)]


def test_spans_that_stand_in_order_stay(spark):
    row = "array<struct<label:string,text:string,start:int,end:int,risk_level:int,confidence:double,rank:int>>"
    span = lambda start, end, risk: ("A", "x", start, end, risk, 0.9, 0)
    cases = [[span(0, 2, 1), span(2, 4, 5), span(7, 9, 2)], [span(7, 9, 2), span(0, 2, 1)], [span(0, 3, 1), span(2, 4, 5)], [span(i, i + 1, 3) for i in range(600)]]
    df = spark.createDataFrame(list(enumerate(cases)), f"i int, s {row}")
    rows = df.select("i", S.in_order(F.col("s")).alias("ok"), S.resolve(F.col("s")).alias("r"), S.first_come(F.col("s")).alias("f"), S.running(F.transform("s", lambda x: x["end"] - x["start"])).alias("n")).orderBy("i").collect()
    assert [r.ok for r in rows] == [True, False, False, True]
    assert [[(x.start, x.end) for x in r.r] for r in rows[:3]] == [[(0, 2), (2, 4), (7, 9)], [(0, 2), (7, 9)], [(2, 4)]]
    assert [[(x.start, x.end) for x in r.f] for r in rows[:3]] == [[(0, 2), (2, 4), (7, 9)], [(0, 2), (7, 9)], [(0, 3)]]
    assert rows[3].n == list(range(600)) and len(rows[3].r) == len(rows[3].f) == 600
