"""BPE encoding and decoding with a public vocabulary file (a tokenizers JSON with word ends).

Merging keeps the symbols of a word in a doubly linked list and a priority queue of merge ranks;
an entry whose pair has changed meanwhile is stale and skipped. Decoding joins vocabulary strings.
Null text counts as empty, and an empty text has no tokens and decodes to the empty string. Special
tokens written out in a text become their ids, as in the tokenizers library. A repeated row is coded again.

Words are normalised (NFC, lower case) and split by Python's Unicode tables. The library's are of other
versions: words with a character on which they differ (`odd_characters`: not assigned in Python's, or
ordered or composed otherwise) are normalised and split by its tables, and then merged like any other.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garim.llm.shared import strings, with_columns

#: Words whose pieces a Python worker remembers at once; then it starts afresh.
REMEMBERED = 600_000
_ODD_SPACES = regex.compile("[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


@lru_cache(maxsize=1)
def odd_characters() -> re.Pattern:
    """Characters that the library's Unicode tables may treat otherwise than Python's. Found by asking it: about the
    order of each combining mark beside another, and about each pair that composes."""
    from tokenizers import normalizers

    theirs, ours = normalizers.NFC().normalize_str, lambda t: unicodedata.normalize("NFC", t)
    kinds = list(map(unicodedata.category, map(chr, range(sys.maxunicode + 1))))
    odd = bytearray(map("Cn".__eq__, kinds))
    for code, kind in enumerate(kinds):
        if kind in ("Cn", "Co", "Cs"):
            continue
        c = chr(code)
        # Classes 1, 216 and 240 stand below, amid and above the others.
        if kind[0] == "M" and any(theirs(t) != ours(t) for t in ("a" + c + "\u0334", "a\u0f39" + c, "a" + c + "\u0f39", "a\u0345" + c)):
            odd[code] = 1
        pair = unicodedata.decomposition(c).split()
        if len(pair) == 2 and pair[0][0] != "<":
            t = "".join(chr(int(x, 16)) for x in pair)
            if theirs(t) != ours(t):
                odd[code] = odd[ord(t[1])] = 1
    ranges = [rf"\U{m.start():08x}-\U{m.end() - 1:08x}" for m in re.finditer(b"\1+", bytes(odd))]
    return re.compile("[" + "".join(ranges) + "]")


@lru_cache(maxsize=2)
def _library_splitter(pattern: str):
    from tokenizers import Regex, normalizers, pre_tokenizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]), pre_tokenizers.Split(Regex(pattern), "removed", invert=True)


class _Remembered(dict):
    """Pieces by word, made where they are missing."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.make(word)
        return found


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            pair = self.ids[left] << 20 | self.ids[right]
            self.merges[pair] = (rank, self.ids[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = token
        self._letters = _byte_letters()
        self._specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self._pattern = pattern
        self._pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self._of_word = _Remembered(lambda word: np.array(self.merge(word), np.int32).tobytes())
        self._of_chunk = _Remembered(lambda chunk: self._words(self._split(chunk)))

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        letters = [self._letters[b] for b in word.encode()]
        letters[-1] += self.suffix
        symbol = [i for i in map(self.ids.get, letters) if i is not None]
        n = len(symbol)
        if n < 2:
            return symbol
        merges = self.merges
        after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if found := merges.get(symbol[i] << 20 | symbol[i + 1]):
                queue.append(found[0] << 40 | i)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & ((1 << 40) - 1)
            j = after[i]
            if symbol[i] < 0 or j < 0:
                continue  # stale: the symbol is gone
            found = merges.get(symbol[i] << 20 | symbol[j])
            if found is None or found[0] != entry >> 40:
                continue  # stale: another pair stands here now
            symbol[i], symbol[j] = found[1], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if right := merges.get(symbol[i] << 20 | symbol[k]):
                    heapq.heappush(queue, right[0] << 40 | i)
            h = before[i]
            if h >= 0 and (left := merges.get(symbol[h] << 20 | symbol[i])):
                heapq.heappush(queue, left[0] << 40 | h)
        return [s for s in symbol if s >= 0]

    def _words(self, words: list[str]) -> bytes:
        return b"".join(map(self._of_word.__getitem__, words))

    def _split(self, text: str) -> list[str]:
        """Normalised pre-tokens."""
        if not text.isascii():
            if odd_characters().search(text):
                return self._split_by_library(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
        return self._pieces.findall(text.lower())

    def _split_by_library(self, text: str) -> list[str]:
        normalizer, splitter = _library_splitter(self._pattern)
        return [piece for piece, _ in splitter.pre_tokenize_str(normalizer.normalize_str(text))]

    def _plain(self, text: str) -> bytes:
        # No character composes with white space, so chunks are normalised one by one.
        if _ODD_SPACES.search(text):  # white space for str.split, but not for the pattern
            return self._words(self._split(text))
        return b"".join(map(self._of_chunk.__getitem__, text.split()))

    def encode(self, text: str | None) -> np.ndarray:
        if len(self._of_chunk) > REMEMBERED:
            self._of_chunk.clear()
        if len(self._of_word) > REMEMBERED:
            self._of_word.clear()
        out, at = [], 0
        text = text or ""
        if "<" in text:
            for m in self._specials.finditer(text):
                out += [self._plain(text[at : m.start()]), np.int32(self.special[m[0]]).tobytes()]
                at = m.end()
        out.append(self._plain(text[at:] if at else text))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with an array of token ids for every text."""
    return _coded(df, vocabulary, text, ids, None)


def encode_decode(
    df: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded"
) -> DataFrame:
    """df with token ids and the text that these decode to."""
    return _coded(df, vocabulary, text, ids, decoded)


def _coded(df: DataFrame, vocabulary: str, text: str, ids: str, decoded: str | None) -> DataFrame:
    def start():
        coder = codec(vocabulary)

        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [coder.encode(t) for t in batch.column(text).to_pylist()]
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(f) for f in found], out=offsets[1:])
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            out = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))]
            if decoded:
                out.append(strings(map(coder.decode, found)))
            return out

        return make

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    fields += [T.StructField(decoded, T.StringType())] if decoded else []
    return with_columns(df, fields, start)


def decode(df: DataFrame, vocabulary: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """df with the text that each id array stands for; a null array gives the empty string."""

    def start():
        coder = codec(vocabulary)
        return lambda batch: [
            strings(coder.decode(np.array(x or [], np.int32)) for x in batch.column(ids).to_pylist())
        ]

    return with_columns(df, [T.StructField(decoded, T.StringType())], start)


def op6(docs: DataFrame, vocabulary: str) -> DataFrame:
    coded = encode_decode(docs.select("doc_id", "text"), vocabulary).drop("text")
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
