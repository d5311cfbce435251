"""Detection over streams: windowed rates, an audit sink, and tokens numbered across batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from garim.functions.spans import exploded
from garim.operators.detectors import detect


def detection_rate(stream: DataFrame, window: str = "10 minutes", late: str = "30 minutes", time: str = "ts", text: str = "text", include: list[str] | None = None) -> DataFrame:
    """Spans of each label per tumbling window of event time; events later than the watermark are dropped."""
    spans = exploded(detect(stream.withWatermark(time, late), text, include=include), time)
    counts = spans.groupBy(F.window(time, window), F.col("s.label").alias("label")).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "label", "n")


def number_tokens(spans: DataFrame) -> DataFrame:
    """(label, original, token) of a stream of (label, original): a value keeps its number for good, and a
    new one gets the next of its label. State is kept per label and part of it (`bucket`), so a frequent
    label is spread; tokens name the bucket."""
    keyed = spans.withColumn("bucket", F.pmod(F.xxhash64("original"), F.lit(64)).cast("int"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        out = []
        for batch in batches:
            for original in batch["original"]:
                known.setdefault(original, len(known) + 1)
                out.append((key[0], original, f"<{key[0]}_{key[1]}_{known[original]}>"))
        state.update((list(known), list(known.values())))
        yield pd.DataFrame(out, columns=["label", "original", "token"])

    return keyed.groupBy("label", "bucket").applyInPandasWithState(
        step, "label string, original string, token string", "originals array<string>, numbers array<int>", "append", GroupStateTimeout.NoTimeout
    )


def audit(stream: DataFrame, folder: str, checkpoint: str):
    """Append audit events as JSON lines, exactly once; returns the running query."""
    return stream.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").start()
