import re

from garim.llm import licenses as L


def bigrams(text):
    ws = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return set(zip(ws, ws[1:]))


def brute(text):
    text = text or ""
    units = [(0, i, u) for i, u in enumerate(text.split("\n"))]
    sentences = [u for u in re.split(r"(?<=[.!?;:])[ \t\r\n]+", text) if re.search("[a-z0-9]", u.lower())]
    units += [(1, (i, k), " ".join(sentences[i : i + k])) for i in range(len(sentences)) for k in range(1, min(L.RUN, len(sentences) - i) + 1)]
    units += [(2, i, u) for i, u in enumerate(re.split(r"\n[ \t\r]*\n", text))] + [(3, 0, text)]
    out = {}
    for name, template in L.TEMPLATES.items():
        t = bigrams(template)
        dice, kind = max((2 * len(bigrams(u) & t) / (len(bigrams(u)) + len(t)), -k) for k, _, u in units)
        if dice >= L.DICE:
            out[name] = (round(dice, 9), L.UNITS[-kind])
    return out


def test_against_brute_force(docs_of, rng):
    texts = [None, "", " ", "mit", "x " * 20000 + "\n" + L.TEMPLATES["MIT"], "LICENSED under the apache   license -- version 2.0", "Released\n\nunder the MIT License.", "Released under the MIT License. " * 150]
    texts += ["Copyright 2024 Example Inc. Released under the MIT License.", "Copyright 2020 Foo Inc. Licensed under the Apache License, Version 2.0. All rights reserved."]
    texts += ["Copyright 2020\n\n" + L.TEMPLATES["BSD-text"].replace("met: ", "met:\n\n1. ").replace("disclaimer. ", "disclaimer.\n\n2. ") + "\n\nint main() {}"]
    for template in L.TEMPLATES.values():
        ws = template.split()
        for cut in (0, 1, 3):
            part = ws[: len(ws) - cut]
            if len(ws) > 20:
                part[7] = "other"
            texts.append("Some prose here.\n" + (" " if rng.random() < 0.5 else "\n").join([" ".join(part[: len(part) // 2]), " ".join(part[len(part) // 2 :])]))
    found = {}
    for r in L.op8(docs_of(texts)).collect():
        found.setdefault(r.doc_id, {})[r.license_id] = (round(r.dice, 9), r.unit)
    for i, text in enumerate(texts):
        assert found.get(i, {}) == brute(text), text
    assert len(found) > 30
    assert "MIT" in found[8] and "Apache-2.0" in found[9] and "BSD-text" in found[10]


def test_key_bigrams_lose_no_match():
    keys = set(L.key_bigrams())
    for _, bigrams_ in L.templates():
        rest = len(set(bigrams_) - keys)
        assert 2 * rest / (rest + len(bigrams_)) < L.DICE


def test_plan_is_native_and_empty(docs_of):
    found = L.op8(docs_of([]).withColumnRenamed("lang", "licenses"))
    assert found.count() == 0 and "Python" not in found._jdf.queryExecution().toString()


def test_sql_gives_the_same_rows(docs_of):
    import duckdb
    import pandas as pd

    texts = ["Released under the MIT License. " * 150, "Copyright 2024. Released under the MIT License.\n\nThis is free and unencumbered\nsoftware released into the public domain; yes", "", "x", None]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    expected = duckdb.sql(L.oracle()).fetchall()
    assert sorted(map(tuple, L.op8(docs_of(texts)).collect())) == sorted(expected) and len(expected) >= 3
