"""Tagged sequences to spans, as gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of_places(rows: DataFrame, doc_id: str, pos: str, ch: str) -> DataFrame:
    """(doc_id, pos, ch) of rows of Parquet files: of those at one place that with a character which comes first in the files, by name
    and row. Which one an aggregate meets first would hang on how tasks split and finish."""
    at = F.struct("_metadata.file_name", "_metadata.row_index")
    placed = rows.select(F.col(doc_id).alias("doc_id"), F.col(pos).cast("long").alias("pos"), F.col(ch).alias("ch"), F.when(F.col(ch).isNotNull(), at).alias("at"))
    return placed.groupBy("doc_id", "pos").agg(F.min_by("ch", "at").alias("ch"))


def bio_spans(tags: DataFrame, chunk: int | None = None) -> DataFrame:
    """(doc_id, label, start, end, text, confidence) of tags (doc_id, pos, ch, tag, score), a character each.
    B- starts a span, I- goes on with one of its label that stands right before, and starts one otherwise;
    anything else is outside. With `chunk`, spans end where a chunk of so many characters does."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    label = F.regexp_extract("tag", "^[BI]-(.+)$", 1)
    part = F.floor(F.col("pos") / chunk) if chunk else F.lit(0)
    marked = tags.select("doc_id", "pos", "ch", "score", "tag", label.alias("label"), part.alias("part"))
    goes_on = (
        F.col("tag").startswith("I-")
        & (F.lag("label").over(order) == F.col("label"))
        & (F.lag("pos").over(order) == F.col("pos") - 1)
        & (F.lag("part").over(order) == F.col("part"))
    )
    fresh = F.when(F.col("label") == "", 1).when(goes_on, 0).otherwise(1)
    islands = marked.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.where("label <> ''").groupBy("doc_id", "island", "label").agg(
        F.min("pos").cast("long").alias("start"),
        (F.max("pos") + 1).cast("long").alias("end"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "").alias("text"),
        F.avg("score").alias("confidence"),
    )
    return spans.drop("island")


def bioes_spans(tags: DataFrame) -> DataFrame:
    """As `bio_spans` for B-, I-, E- and S- tags: S- is a span alone, E- ends one."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    label = F.regexp_extract("tag", "^[BIES]-(.+)$", 1)
    marked = tags.select("doc_id", "pos", "ch", "score", "tag", label.alias("label"), F.substring("tag", 1, 1).alias("kind"))
    open_ = F.lag("kind").over(order).isin("B", "I") & (F.lag("label").over(order) == F.col("label")) & (F.lag("pos").over(order) == F.col("pos") - 1)
    goes_on = F.col("kind").isin("I", "E") & F.coalesce(open_, F.lit(False))
    plain = F.when(F.col("label") == "", F.lit("O")).otherwise(F.concat(F.when(goes_on, F.lit("I-")).otherwise(F.lit("B-")), "label"))
    return bio_spans(marked.select("doc_id", "pos", "ch", plain.alias("tag"), "score"))


def chunks(tags: DataFrame, size: int, overlap: int) -> DataFrame:
    """Tags with the tumbling chunk they are in, and besides those of up to `overlap` places before and behind it, as a model gets
    them: (doc_id, chunk, pos, ..., core). core marks the chunk's own places."""
    if overlap >= size:
        raise ValueError("chunks must be longer than what they share")
    own = F.floor(F.col("pos") / size).cast("long")
    near = F.array(own, F.floor((F.col("pos") - overlap) / size).cast("long"), F.floor((F.col("pos") + overlap) / size).cast("long"))
    dealt = tags.select(*tags.columns, F.explode(F.array_distinct(F.filter(near, lambda c: c >= 0))).alias("chunk"))
    return dealt.withColumn("core", F.col("chunk") == F.floor(F.col("pos") / size))


def joined_chunks(dealt: DataFrame) -> DataFrame:
    """The tags of whole texts from those of `chunks`: each place's tag is that of its own chunk, and an entity that a cut parts is
    carried over it, so that decoding chunks gives what decoding the text gives. A place that no chunk calls its own takes the tag of
    the best score."""
    best = F.max_by(F.struct(*[c for c in dealt.columns if c not in ("doc_id", "pos", "chunk", "core")]), F.struct("core", "score", -F.col("chunk")))
    return dealt.groupBy("doc_id", "pos").agg(best.alias("t")).select("doc_id", "pos", "t.*")


def carried(tags: DataFrame, size: int) -> DataFrame:
    """Tags of texts that were decoded chunk by chunk, where each chunk begins afresh: a B- right at a cut becomes I- where the chunk
    before ends within an entity of that label."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    inside = F.regexp_extract(F.lag("tag").over(order), "^[BI]-(.+)$", 1) == F.regexp_extract("tag", "^B-(.+)$", 1)
    joins = (F.col("pos") % size == 0) & F.col("tag").startswith("B-") & inside & (F.lag("pos").over(order) == F.col("pos") - 1)
    return tags.withColumn("tag", F.when(F.coalesce(joins, F.lit(False)), F.regexp_replace("tag", "^B-", "I-")).otherwise(F.col("tag")))
