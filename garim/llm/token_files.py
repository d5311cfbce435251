"""Token ids of a corpus as ORC files in the order of document ids, and readers of these files.

`write` deals documents to files by ranges of their ids, encodes them with the tokenizers library and ends each with
an id of its own. A file is a part: its rows hold a document's id, the part, the count of ids before the document in
its part, and the ids, as integers, which ORC stores run-length encoded in stripes. Row indexes, one entry for each
`STRIDE` documents, and Bloom filters on document ids let a reader skip what can't hold a document. A second, small table
(`index`) has one row for each part: its first and last document, and the ids of all parts before it.

`read` splits files by stripes, so tasks read stripes in parallel. `documents` reads some documents: the index leaves out
files, footers and Bloom filters leave out stripes and row groups.

The library is asked once for each distinct word. Texts are cut at ASCII white space, which the vocabulary's
pre-tokenizer drops, and pieces in Latin-1 without apostrophes or special tokens between letters and other
characters, which it never joins; other pieces go to the library as they are.

Null and empty texts hold the end id alone. Rows without a document id come first; rows of one id stand in the order of
their texts' hashes, and each repeated row is a document. An empty table gives files without rows. Only the two columns
named are read. A very long text is one row: what is encoded at once holds it and at most `AT_ONCE` bytes besides.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garim.llm.chunks import Remembered, encoded, gathered
from garim.llm.shared import Texts, shared_folder, small_batches, with_columns

END_ID = 2
#: Bytes of text that are encoded at once: the more, the fewer words are looked up twice.
AT_ONCE = 8 << 20
STRIDE = 1000
ORC = {
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(STRIDE),
    "orc.stripe.size": str(16 << 20), "compression": "zstd",
}
#: Parts whose index may be broadcast: a row each, 24 bytes.
MOST_BROADCAST = 1_000_000

@lru_cache(maxsize=2)
def _lookup(vocabulary: str) -> Remembered:
    """Ids of pieces as `_pieces` cuts them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    library.no_truncation()
    library.no_padding()

    def ask(pieces: list[str]) -> list[bytes]:
        return [array("i", x.ids).tobytes() for x in library.encode_batch_fast(pieces, add_special_tokens=False)]

    return Remembered(ask)


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _pieces(column: pa.Array) -> pa.ListArray:
    """What each text is cut into. Pieces between ASCII white space that are in Latin-1, without apostrophe or `<|`, come in lower
    case and cut between letters and other characters, all others as they are."""
    texts = Texts(column)
    kept = ~_BLANK[texts.buf]
    begins = np.zeros(len(kept) + 1, bool)
    begins[texts.offs] = True
    begins[1:-1] |= ~kept[:-1]
    begins, data = begins[:-1][kept], texts.buf[kept]
    of_text = np.concatenate([[0], np.cumsum(kept)])[texts.offs]
    if len(data):
        whole = (data >= 0xC4) | (data == ord("'"))
        whole[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        at = np.flatnonzero(begins)
        plain = np.repeat(~np.logical_or.reduceat(whole, at), np.diff(np.append(at, len(data))))
        letter, lower = _LETTER[data], _LOWER[data]
        lead = np.flatnonzero(((data == 0xC2) | (data == 0xC3)) & plain)
        second = data[lead + 1]
        capital = (data[lead] == 0xC3) & (second != 0x97) & (second < 0x9F)
        lower[lead[capital] + 1] += 0x20
        letter[lead] = np.where(data[lead] == 0xC3, (second != 0x97) & (second != 0xB7), np.isin(second, [0xAA, 0xB5, 0xBA]))
        letter[lead + 1] = letter[lead]
        begins[1:] |= plain[1:] & (letter[1:] != letter[:-1])
        data = np.where(plain, lower, data)
    cuts = np.flatnonzero(begins)
    words = pa.Array.from_buffers(pa.large_string(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data))), pa.py_buffer(data)])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(cuts, of_text), pa.int32()), words)


def encode_batch(texts: pa.Array, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, one after the other, and the bounds of the texts (n + 1)."""
    return encoded(_pieces(texts), _lookup(vocabulary))


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> None:
    """Token files of docs at `path`, which must not exist."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in gathered(batches, AT_ONCE):
            ids, bounds = encode_batch(batch.column(1), vocabulary)
            n = len(batch)
            ended = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(n + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(before + bounds[:-1]),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ended, pa.int32())), pa.array(np.diff(bounds)),
                ],
                names=["doc_id", "part", "before", "token_ids", "n_tokens"],
            )
            before += int(bounds[-1])

    keys = [F.col(key), F.xxhash64(text)]
    dealt = docs.select(F.col(key).cast("long").alias(key), text).repartitionByRange(*keys).sortWithinPartitions(*keys)
    coded = dealt.mapInArrow(run, "doc_id long, part int, before long, token_ids array<int>, n_tokens long")
    coded.write.format("orc").options(**ORC).save(f"{path}/parts")

    # A row for each file.
    parts = spark.read.orc(f"{path}/parts").groupBy("part").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"), F.sum("n_tokens").alias("ids")).collect()
    start, index = 0, []
    for p in sorted(parts, key=lambda p: p["part"]):
        index.append((p["part"], p["first"], p["last"], p["n"], p["ids"], start))
        start += p["ids"]
    spark.createDataFrame(index, "part int, first_id long, last_id long, n_documents long, n_tokens long, start long").coalesce(1).write.orc(f"{path}/index")


def index(spark: SparkSession, path: str) -> DataFrame:
    """A row for each part: (part, first_id, last_id, n_documents, n_tokens, start)."""
    return spark.read.orc(f"{path}/index")


def _placed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    starts = parts.select("part", F.col("start").alias("of_part"))
    if parts.count() <= MOST_BROADCAST:
        starts = F.broadcast(starts)
    return rows.join(starts, "part").select("doc_id", (F.col("of_part") + F.col("before")).alias("start"), "n_tokens", "token_ids")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, token_ids) of all documents."""
    return _placed(spark.read.orc(f"{path}/parts"), index(spark, path))


def documents(spark: SparkSession, path: str, ids: Iterable[int]) -> DataFrame:
    """Those of some documents."""
    wanted = sorted(set(ids))
    parts = index(spark, path)
    holds = F.exists(F.array(*[F.lit(i).cast("long") for i in wanted]), lambda i: i.between(F.col("first_id"), F.col("last_id")))
    near = [r["part"] for r in parts.where(holds).select("part").collect()] if wanted else []
    rows = spark.read.orc(f"{path}/parts").where(F.col("part").isin(near) & F.col("doc_id").isin(wanted))
    return _placed(rows, parts)


def with_crc32(df: DataFrame, ids: str = "token_ids", name: str = "ids_crc32") -> DataFrame:
    """df with the CRC-32 of each array's integers as little-endian words of four bytes."""

    def start():
        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(ids)
            words, bounds = column.flatten().to_numpy(zero_copy_only=False).astype("<u4"), column.offsets.to_numpy()
            bounds = bounds - bounds[0]
            return [pa.array([zlib.crc32(words[a:z]) for a, z in zip(bounds[:-1], bounds[1:], strict=True)], pa.int64())]

        return make

    return with_columns(df, [T.StructField(name, T.LongType())], start)


def op12(docs: DataFrame, vocabulary: str) -> DataFrame:
    path = f"{shared_folder(docs.sparkSession)}/garim-token-files-{uuid.uuid4().hex}"
    write(docs, path, vocabulary)
    return with_crc32(read(docs.sparkSession, path)).drop("token_ids")
