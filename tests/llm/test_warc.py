import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from garim.llm import warc


@pytest.mark.parametrize("sizes", [[], [0], [5, 0, 70000], list(range(0, 4000, 40))])
def test_archive_round_trip(sizes):
    records = [warc.record(i, f"http://x/{i}", (b"<p>some text %d</p>" % i * 4000)[:n], 1 if n == 40 else None) for i, n in enumerate(sizes)]
    archive = warc.packed(records)
    assert list(warc.unpacked(archive)) == records
    assert archive[:4] == bytes.fromhex("5d2a4d18")


def test_records_stand_alone_and_damage_shows():
    records = [warc.record(i, None, b"body %d " % i * 300) for i in range(40)]
    archive = warc.packed(records)
    size = int.from_bytes(archive[4:8], "little")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size]))
    frame = reader.decompressobj()
    assert frame.decompress(archive[8 + size :]) == records[0] and frame.unused_data
    with pytest.raises(ValueError):
        list(warc.unpacked(archive[:-10]))
    with pytest.raises(ValueError):
        warc.parsed(records[0].replace(b"body 0", b"bodY 0", 1))
    with pytest.raises(ValueError):
        list(warc.unpacked(b"12345678"))


def test_query(spark, tmp_path):
    big, small = "é" * 600, "s" * 999
    pages = [(1, "u1", big), (2, "u\n2", big), (3, None, big), (4, "u4", small), (5, "u5", small), (6, "u6", None), (7, "u7", ""), (None, "u8", big)]
    pages += [(100 + i, f"u{i}", f"<p>{i}</p>" * 50) for i in range(30)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, refers_to string").repartition(3)
    rows = warc.op7(df).collect()
    assert len(rows) == len(pages)
    found = {r.page_id: r for r in rows}
    for page, _, html in pages:
        payload = (html or "").encode()
        assert (found[page].payload_bytes, found[page].payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
    assert {p: r.refers_to for p, r in found.items() if r.record_type == "revisit"} == {1: 3, 2: 3}
    assert warc.op7(df.limit(0)).count() == 0


def test_files_hold_urls_and_payloads(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/é", "<p>x</p>" * 999), (2, "", "y")], "page_id long, url string, html string")
    manifest = warc.write(df, f"file://{tmp_path}/archives", archive=1000)
    assert sum(r.n_records for r in manifest.collect()) == 2 and len(list((tmp_path / "archives").glob("*.warc.zst"))) >= 2
    found = {r.page_id: r for r in warc.read(manifest).collect()}
    assert found[1].url == "http://a/é" and bytes(found[1].payload) == b"<p>x</p>" * 999 and found[2].url is None


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    df = spark.createDataFrame([(i, None, f"<p>{i}</p>" * 200) for i in range(200)], "page_id long, url string, html string")
    manifest = warc.write(df, f"file://{tmp_path}/many", archive=4000)
    found = warc.read(manifest)
    assert manifest.count() > 8 * warc.TOGETHER
    tasks = found.select("page_id", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.page_id for r in tasks) == list(range(200)) and len({r.task for r in tasks}) > 4
