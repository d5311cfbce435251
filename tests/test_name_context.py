import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from garim.functions import spans as S
from garim.operators import name_context as N
from garim.operators.detectors import detect


def by_definition(spans, text):
    """The three passes with a dictionary of names."""
    sentence = lambda s: sum(c in ".!?\n" for c in text[: s[2]])
    names, taken, pending = {}, [], []

    def add(s, total):
        names[s[1]] = max(total, names.get(s[1], 0.0))
        taken.append((s[1], s[2], round(total, 2)))

    for s in sorted(spans, key=lambda s: s[2]):
        total = min(1.0, s[5] + min(0.4, names.get(s[1], 0.0)))
        if total >= 0.5:
            add(s, total)
        else:
            pending.append((s, total))
    strong = {sentence(s) for s in spans for t in taken if t[1] == s[2] and t[0] == s[1] and t[2] >= 0.7}
    rest = []
    for s, total in pending:
        if sentence(s) in strong and total + 0.15 >= 0.5:
            add(s, total + 0.15)
        else:
            rest.append(s)
    known = dict(names)
    for s in rest:
        if s[1] in known and min(1.0, s[5] + min(0.4, known[s[1]])) >= 0.5:
            taken.append((s[1], s[2], round(min(1.0, s[5] + min(0.4, known[s[1]])), 2)))
    return sorted(taken, key=lambda t: t[1])


def test_passes_as_by_definition(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("가나다라 . \n!") for _ in range(3000))
    sets = []
    for n in [0, 1, 2, 5, 8, 20] * 20 + [600]:
        places = sorted(rng.sample(range(2900), n))
        sets.append([("PERSON", rng.choice(("홍길동", "김철수", "이영희", "박")), p, p + 3, 4, rng.choice((0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 1.0)), 0) for p in places])
    df = spark.createDataFrame(list(enumerate(sets)), f"i int, spans array<{S.SPAN}>").withColumn("t", F.lit(text))
    for r in df.select("i", N.accumulated(F.col("spans"), F.col("t")).alias("out")).collect():
        assert [(s.text, s.start, s.confidence) for s in r.out] == by_definition(sets[r.i], text), r.i


def test_many_candidates(spark):
    def taken(n):
        text = "\n".join(f"성명: 홍길동 과장. 김철{chr(0xAC00 + i % 500)} 옴" for i in range(n))
        found = detect(spark.createDataFrame([(text,)], "text string"), include=["PERSON"]).select(F.size("spans").alias("n"))
        assert found.first().n == n
        times = []
        for _ in range(2):
            began = time.perf_counter()
            found.collect()
            times.append(time.perf_counter() - began)
        return min(times)

    assert taken(1600) < 8 * taken(400)


def test_repeated_and_misleading_names(spark):
    texts = ["김철수는 갔다. 성명: 김철수. 김철수도 왔다", "김철수는 갔다. 성명: 홍길동", None, "", "성명: 홍길동 과장과 김철수는"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = {r.i: [(s.text, s.start, s.confidence) for s in r.spans] for r in detect(df, include=["PERSON"]).collect()}
    assert rows[0] == [("김철수", 0, 0.55), ("김철수", 13, 0.65), ("김철수", 18, 0.55)]
    assert rows[1] == [("홍길동", 13, 0.65)] and rows[2] == [] and rows[3] == []
    assert [s[0] for s in rows[4]] == ["홍길동"]


def test_syllables_by_counting(spark):
    words = [("홍길동", True), ("김길수", True), ("바나나", False), ("나라", False), ("길", False), (None, True), ("동길", None), ("abc", True)]
    rows = {r.syllable: r for r in N.fit_syllables(spark.createDataFrame(words, "word string, is_name boolean")).collect()}
    names, others = Counter("길동길수"), Counter("나나라")
    kinds = set(names) | set(others)
    assert set(rows) == kinds
    for s in kinds:
        want = math.log((names[s] + 1) / (4 + len(kinds)) / ((others[s] + 1) / (3 + len(kinds))))
        assert (rows[s].n_name, rows[s].n_other) == (names[s], others[s]) and rows[s].log_odds == pytest.approx(want)
    assert N.fit_syllables(spark.createDataFrame([], "word string, is_name boolean")).count() == 0


def test_model_lets_a_name_in(spark):
    labelled = spark.createDataFrame(
        [("성명 김철수 바나나", [(3, 6, "PERSON")]), ("김철수 왔다", [(0, 3, "PERSON")]), ("", None)], "text string, spans array<struct<start:int,end:int,label:string>>"
    )
    words = N.labelled_words(labelled)
    assert sorted((r.word, r.is_name) for r in words.collect()) == [("김철수", True), ("김철수", True), ("바나나", False), ("성명", False), ("왔다", False)]
    model = N.Syllables.of(N.fit_syllables(words.union(spark.createDataFrame([("김철수", True)] * 20 + [("박나나", False)] * 20, "word string, is_name boolean"))))
    df = spark.createDataFrame([(1, "성명: 홍길동 과장과 김철수는"), (2, "성명: 홍길동 과장과 박나나는")], "i int, text string")
    rows = {r.i: [s.text for s in r.spans] for r in detect(df, include=["PERSON"], names=model).collect()}
    assert rows == {1: ["홍길동", "김철수"], 2: ["홍길동"]}
    assert spark.range(1).select(N.Syllables(()).bonus(F.lit("김철수"))).first()[0] in (0.0, 0.05)
