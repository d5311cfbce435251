"""WARC archives compressed with a Zstandard dictionary.

Each Spark task packs its pages into archives of about `ARCHIVE` bytes before compression. A dictionary
is built from records spread over the archive and stands in a leading skippable frame; every record is
a frame of its own, so one can be read without the others. Archives go to the shared folder, under new
names for each attempt of a task; the manifest lists those of the attempts that count.

Of pages with equal payloads of at least `REVISIT` bytes, that with the largest id is a response and the
others are revisits of it. Groups are found on (digest, length, id) rows, pre-aggregated and written before they
are joined, so that the join can be split where a third of all pages share a payload; only the revisits' ids
are joined to the pages, by page.

Null html is an empty payload; a null url gives a record without a target; a page without an id is always
a response. A page row that is repeated gives as many records. An empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garim.llm.shared import saved, shared_folder, small_batches

ARCHIVE = 8 << 20
REVISIT = 1000
DICTIONARY = 16 << 10
#: Bytes of an archive's records that its dictionary is built from, spread evenly, and of each of them at most.
TRAINED_ON = 1 << 20
OF_EACH = 64 << 10
#: Archives that one task reads back, about.
TOGETHER = 4
SKIPPABLE = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC record: a response with the payload, or a revisit that only has its digest and length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """What a record says: page_id, url, payload (None for a revisit), payload_bytes, payload_digest,
    record_type, refers_to. A response's payload must have the digest that its header names."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload": None if revisit else payload,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None,
    }


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary built from records spread over the archive; too few to train on are used as they are."""
    every = max(1, sum(map(len, records)) // TRAINED_ON)
    samples = [r[:OF_EACH] for r in records[::every]]
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY, samples, k=512, d=8)
        except zstandard.ZstdError:
            pass  # too little in them that repeats
    return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY].ljust(8, b"\0"))


def packed(records: list[bytes]) -> bytes:
    """An archive: the dictionary in a skippable frame, then a frame for each record."""
    words = dictionary(records)
    raw = words.as_bytes()
    packer = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=True)
    return struct.pack("<II", SKIPPABLE, len(raw)) + raw + b"".join(map(packer.compress, records))


def unpacked(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one after the other."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size]))
    at, view, step = 8 + size, memoryview(archive), 4096
    while at < len(view):
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ValueError("the last frame is cut short")
            out.append(frame.decompress(view[at : at + step]))
            at += min(step, len(view) - at)
        at -= len(frame.unused_data)
        yield b"".join(out)


def revisits(pages: DataFrame, least: int = REVISIT) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the pages that only repeat another's payload."""
    narrow = pages.select(
        "page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("payload_digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size")
    ).where(F.col("size") >= least)
    groups = narrow.groupBy("payload_digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    shared = saved(groups.where("n > 1").drop("n"), "shared-payloads")
    return narrow.join(shared, ["payload_digest", "size"]).where("page_id <> refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def write(pages: DataFrame, folder: str, least: int = REVISIT, archive: int = ARCHIVE) -> DataFrame:
    """Write pages (page_id, url, html) as archives into a folder that all machines share; returns the
    manifest (path, n_records, n_bytes), itself a written table."""
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = pages.withColumn("payload_digest", F.sha1("html")).join(revisits(pages, least), ["page_id", "payload_digest"], "left")
    rows = rows.select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)

        def flush(records: list[bytes]) -> pa.RecordBatch:
            data, name = packed(records), f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [len(records)], "n_bytes": [len(data)]})

        held, size = [], 0
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("page_id", "url", "html", "refers_to")]
            for page, url, html, refers_to in zip(*columns, strict=True):
                held.append(record(page, url, html.encode(), refers_to))
                size += len(held[-1])
                if size >= archive:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return saved(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that a manifest lists, a task for each `TOGETHER` of them or fewer."""
    small_batches(manifest.sparkSession)
    names = ["page_id", "url", *["payload"] * payloads, "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = {"payload": ("binary", pa.binary()), "page_id": ("long", pa.int64()), "payload_bytes": ("long", pa.int64()), "refers_to": ("long", pa.int64())}
    schema = pa.schema([(n, kinds.get(n, ("string", pa.string()))[1]) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_stream(inner) as file:
                    data = file.read()
                rows = []
                for item in unpacked(data):
                    found = parsed(item)
                    rows.append({n: found[n] for n in names})
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    # The count of partitions is given: lists of paths are small, and adaptive execution would merge them into one.
    spread = manifest.select("path").repartition(max(1, math.ceil(manifest.count() / TOGETHER)), "path")
    return spread.mapInArrow(run, ", ".join(f"{n} {kinds.get(n, ('string',))[0]}" for n in names))


def op7(pages: DataFrame) -> DataFrame:
    folder = f"{shared_folder(pages.sparkSession)}/garim-warc-{uuid.uuid4().hex}"
    return read(write(pages, folder), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows for op7 without an archive.
ORACLE = """
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages
), d as (
  select page_id, cast(payload_bytes as bigint) as payload_bytes, sha1(html) as payload_digest,
         max(page_id) over (partition by sha1(html), payload_bytes) as last from p
)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> last then last end as refers_to
from d
"""
