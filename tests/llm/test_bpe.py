import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from garim.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
POOL = ["a", "à", "À", "Σ", "σς", "İ", "ß", "'s", "'LL", "ﬁ", "²", "٣", "7", " ", "\t", "\n", "\x0b", "\x1c", "\x85", "　", "​", "é", "한글", "漢字", "😀", "<|endoftext|>", "<|", "!?", "the", "Tokenizer", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_and_text_as_the_library(library, rng):
    codec = bpe.codec(PATH)
    texts = ["", " ", "x" * 5000, *("".join(rng.choice(POOL) for _ in range(rng.randint(0, 12))) for _ in range(3000))]
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        ids = codec.encode(text)
        assert ids.tolist() == expected, repr(text)
        assert codec.decode(ids) == library.decode(expected, skip_special_tokens=False), repr(text)


def test_small_memory_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    codec = bpe.Codec(PATH)
    for text in ("one two three four five six", "seven eight one two"):
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_query_digests(spark, docs_of, library):
    texts = ["The cat's hat.", None, "", "naïve Ünïcode 123", "The cat's hat."]
    found = {r.doc_id: r for r in bpe.op6(docs_of(texts), PATH).collect()}
    assert len(found) == 5
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_columns_and_empty_table(spark, docs_of):
    clash = docs_of(["a b"]).withColumnRenamed("source", "token_ids")
    row = bpe.decode(bpe.encode(clash, PATH), PATH).first()
    assert row.token_ids and row.decoded == "a</w> b</w>" and row.lang == "en"
    assert bpe.encode(docs_of([]), PATH).count() == 0


def test_every_code_point_as_the_library_has_it(library):
    codec = bpe.codec(PATH)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(codes), 4096):
        texts = [f"a{chr(c)}b" for c in codes[start : start + 4096]]
        for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert codec.encode(text).tolist() == expected.ids, ascii(text)
        codec._of_chunk.clear()


def test_pairs_of_rare_characters(library, rng):
    codec = bpe.codec(PATH)
    marks = [c for c in map(chr, range(0x110000)) if bpe.unicodedata.combining(c)]
    halves = [chr(int(p, 16)) for c in map(chr, range(0x110000)) for p in bpe.unicodedata.decomposition(c).split() if p[0] != "<"]
    texts = ["a\u0f39\U00011a47"]
    texts += ["".join(rng.choice(rng.choice((marks, halves, ["a", "Σ", " ", "\u0378", "\U0001c895", "\x1c"]))) for _ in range(rng.randint(2, 5))) for _ in range(40000)]
    for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert codec.encode(text).tolist() == expected.ids, ascii(text)



def test_words_of_a_large_corpus_are_merged_once(monkeypatch):
    coder = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    asked = []
    monkeypatch.setattr(bpe.Codec, "merge", lambda self, word: asked.append(word) or [7])
    text = " ".join("".join("abcdefghij"[int(d)] for d in str(i)) for i in range(250_000))
    for t in (text, "a", text):
        coder.encode(t)
    assert len(asked) == 250_000
