"""Running sums and ranks over large groups: a range shuffle, sums of its partitions, and no window over a whole group.

Where rows are dealt to ranges twice, the ranges may differ, so they are written once to the folder that all machines share and
read from there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where there is none a local master gets a local one, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file:///tmp/garim-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/garim-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_running(df: DataFrame, by: list[str], sums: dict[str, Column], group: list[str] | None = None) -> DataFrame:
    """df with, for each name of `sums`, the sum of its value over all rows before in the order of `by`, within the group if there
    is one; rows that are equal in `by` stand in any order. Columns that begin with _ must not be there."""
    keys = [*(group or []), *by]
    dealt = written(df, "ordered-input").withColumn("_nth", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*keys, "_nth").withColumn("_part", F.spark_partition_id())
    dealt = written(dealt.withColumns({f"_v_{n}": c for n, c in sums.items()}), "ordered")
    within = Window.partitionBy("_part", *(group or [])).orderBy(*by, "_nth").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each partition and group in it: windows over these hold as many rows as there are partitions.
    parts = dealt.groupBy("_part", *(group or [])).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *[F.col(g).alias(f"_g_{g}") for g in group or []], *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    own = dealt.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)).alias(f"_w_{n}") for n in sums])
    return own.join(parts.withColumnRenamed("_part", "_of"), F.expr(" and ".join(["_part = _of", *[f"`{g}` <=> `_g_{g}`" for g in group or []]]))).select(
        *df.columns, *[(F.col(f"_w_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums]
    )
