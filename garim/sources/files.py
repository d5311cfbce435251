"""Texts and records from files, read by Spark and decoded in Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garim.functions import broken

EXTENSIONS = ("txt", "md", "csv", "tsv", "docx", "xlsx", "hwpx")
_ENCODINGS = ("utf-8", "cp949", "euc-kr")


def decoded(content: bytes) -> str:
    for name in _ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _run_text(xml: bytes, breaks: frozenset[str]) -> str:
    out = []
    for event, node in ElementTree.iterparse(io.BytesIO(xml), ("start", "end")):
        name = _local(node.tag)
        if event == "end" and name == "t":
            out.append(node.text or "")
        elif event == "end" and name == "tab":
            out.append("\t")
        elif event == "end" and name in breaks:
            out.append("\n")
    return "".join(out)


def docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = [n for n in sorted(z.namelist()) if re.fullmatch(r"word/(document|header\d*|footer\d*)\.xml", n)]
        parts.sort(key=lambda n: "document" not in n)
        return "".join(_run_text(z.read(n), frozenset(("p", "br"))) for n in parts)


def hwpx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = [n for n in sorted(z.namelist()) if re.search(r"section[^/]*\.xml$", n, re.I)]
        return "".join(_run_text(z.read(n), frozenset(("p", "lineBreak", "linesegarray"))) for n in parts)


def xlsx_rows(content: bytes) -> list[list[str]]:
    """All rows of all sheets; cells stand where their references say."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if _local(t.tag) == "t"))
        rows = []
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for row in (r for r in ElementTree.fromstring(z.read(name)).iter() if _local(r.tag) == "row"):
                cells: dict[int, str] = {}
                for place, cell in enumerate(c for c in row if _local(c.tag) == "c"):
                    letters = re.match("[A-Z]+", cell.get("r", ""))
                    at = place
                    if letters:
                        at = 0
                        for ch in letters[0]:
                            at = at * 26 + ord(ch) - 64
                        at -= 1
                    value = "".join(t.text or "" for t in cell.iter() if _local(t.tag) in ("v", "t"))
                    cells[at] = shared[int(value)] if cell.get("t") == "s" and value else value
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        return rows


def text_of(path: str, content: bytes) -> str:
    kind = path.rpartition(".")[2].lower()
    if kind == "docx":
        return docx_text(content)
    if kind == "hwpx":
        return hwpx_text(content)
    if kind == "xlsx":
        return "\n".join("\t".join(row) for row in xlsx_rows(content))
    return decoded(content)


def read_texts(spark: SparkSession, folder: str, way_back: bool = False) -> DataFrame:
    """(path, text, error) of all files under a folder whose kind is known; a damaged file has an error. Broken lines and
    spaced fields are repaired in all kinds; `way_back` adds the text as it was (`raw`) and the state (`whole`) by which
    `offsets.to_source` leads spans back to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS)).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows.append({"path": path, "raw": text_of(path, content), "error": None})
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError) as e:
                    rows.append({"path": path, "raw": None, "error": type(e).__name__})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("raw", pa.string()), ("error", pa.string())]))

    found = files.mapInArrow(run, "path string, raw string, error string")
    found = broken.with_repaired(found, "raw", "whole").withColumn("text", F.col("whole.text"))
    return found.select("path", "text", "error", *(["raw", "whole"] if way_back else []))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a delimited file with a header, all strings; the delimiter is told by the first lines,
    and rows without any value are left out."""
    first = spark.read.text(path).limit(5).collect()
    sample = "\n".join(r.value for r in first)
    separator = max(",\t;|", key=lambda s: (sample.split("\n")[0].count(s), -",\t;|".index(s)))
    found = spark.read.option("header", True).option("multiLine", True).option("sep", separator).option("escape", '"').csv(path)
    some = F.lit(False)
    for c in found.columns:
        some = some | (F.coalesce(F.col(f"`{c}`"), F.lit("")) != "")
    return found.where(some)


def write_texts(df: DataFrame, folder: str) -> None:
    """Write (path, text) as a table whose `name` is the stem, with part of a digest where stems clash."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    clash = df.groupBy(stem.alias("stem")).agg(F.count("*").alias("n"), F.min("path").alias("first"))
    named = df.withColumn("stem", stem).join(clash, "stem")
    name = F.when(F.col("path") == F.col("first"), F.col("stem")).otherwise(F.concat_ws("_", "stem", F.substring(F.sha1("path"), 1, 8)))
    named.select(name.alias("name"), "path", "text").write.mode("overwrite").parquet(folder)
