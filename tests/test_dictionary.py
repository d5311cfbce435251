import random

import pytest
from pyspark.sql import functions as F

from garim.operators import dictionary as D
from garim.operators.detectors import detect


def by_definition(text, terms, edge):
    out, at = [], 0
    while at < len(text or ""):
        for term in sorted(terms, key=len, reverse=True):
            end = at + len(term)
            if text.startswith(term, at) and not (at and text[at - 1] in edge) and not (end < len(text) and text[end] in edge):
                out.append((term, at, end))
                at = end - 1
                break
        at += 1
    return out


@pytest.mark.parametrize("small", [0, 1000])
def test_longest_terms_by_definition(spark, monkeypatch, small):
    monkeypatch.setattr(D, "SMALL_TERMS", small)
    rng = random.Random(7)
    terms = sorted({"".join(rng.choice("abc-가.") for _ in range(rng.randint(1, 4))) for _ in range(80)})
    texts = [None, "", *("".join(rng.choice("abc-가. 😀") for _ in range(rng.randint(1, 40))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    table = spark.createDataFrame([(t,) for t in terms] + [(None,), ("",), (terms[0],)], "term string")
    for r in D.with_terms(df, D.Terms.of(table, "a가")).collect():
        assert [tuple(x) for x in r.terms or []] == by_definition(texts[r.i], terms, "a가"), repr(texts[r.i])


def test_pairs_and_their_rejected_neighbours(spark):
    table = spark.createDataFrame([("서울", None), ("부산", None), ("강남구", "서울"), ("중구", "서울"), ("중구", "부산"), ("해운대구", "부산")], "term string, parent string")
    texts = ["서울 강남구 역삼", "부산 강남구", "부산 중구, 서울 중구", "새서울 강남구", "서울  강남구", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = sorted((r.i, r.first, r.second, r.start, r.end, r.valid) for r in D.known_pairs(df, table).collect())
    assert found == [(0, "서울", "강남구", 0, 6, True), (1, "부산", "강남구", 0, 6, False), (2, "부산", "중구", 0, 5, True), (2, "서울", "중구", 7, 12, True)]


def test_detectors_read_dictionaries(spark):
    schools = D.Terms(("한빛대학교", "한빛대", "누리 대학원"))
    df = spark.createDataFrame([(1, "한빛대학교 졸업, 누리 대학원 재학, 새한빛대 중퇴"), (2, None)], "i int, text string")
    rows = {r.i: [(s.label, s.text, s.start) for s in r.spans] for r in detect(df, include=["EDUCATION"], dictionaries={"EDUCATION": schools}).collect()}
    assert rows == {1: [("EDUCATION", "한빛대학교", 0), ("EDUCATION", "누리 대학원", 10)], 2: []}
    assert D.with_terms(df, D.Terms(())).where(F.size("terms") > 0).count() == 0


def test_too_large_a_dictionary_is_refused(spark, monkeypatch):
    monkeypatch.setattr(D, "MOST_TERMS", 2)
    with pytest.raises(ValueError):
        D.Terms.of(spark.createDataFrame([("a",), ("b",), ("c",)], "term string"))


def test_automaton_holds_no_object_for_each_find_of_a_batch(spark, monkeypatch):
    """Parts of a batch come out in order, with empty and null texts, and no more than a part's finds are objects at once."""
    monkeypatch.setattr(D, "SMALL_TERMS", 0)
    monkeypatch.setattr(D, "AT_ONCE", 3)
    texts = ["ab cd", "", None, "cd", "x", "abcd ab", "cd  ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    found = D.with_terms(rows, D.Terms(("ab", "cd")), "t").orderBy("i").collect()
    assert [[(x.term, x.start, x.end) for x in r.terms] for r in found] == [[("ab", 0, 2), ("cd", 3, 5)], [], [], [("cd", 0, 2)], [], [("ab", 5, 7)], [("cd", 0, 2), ("ab", 4, 6)]]
