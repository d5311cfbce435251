"""Document summaries, combined risk and k-anonymity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garim.functions.labels import attribute_class


def combined_risk(labels: Column) -> Column:
    """Risk 1 to 5 of a set of labels: any identifier gives 5; four, two or one quasi-identifiers 4, 3, 2;
    a sensitive label adds one."""
    of = lambda kind: F.size(F.filter(F.array_distinct(labels), lambda x: attribute_class(x) == kind))
    quasi = of("quasi_identifier")
    level = F.when(of("identifier") > 0, 5).when(quasi >= 4, 4).when(quasi >= 2, 3).when(quasi == 1, 2).otherwise(1)
    return F.least(F.lit(5), level + (of("sensitive") > 0).cast("int"))


def summaries(df: DataFrame, spans: str = "spans") -> DataFrame:
    """df with total, blocked, review, n_labels, combined_risk and re_identifiable of its spans."""
    labels = F.transform(spans, lambda s: s["label"])
    with_action = lambda a: F.size(F.filter(spans, lambda s: s["action"] == a)).cast("long")
    return df.withColumns(
        {
            "total": F.size(spans).cast("long"),
            "blocked": with_action("BLOCK"),
            "review": with_action("REVIEW"),
            "n_labels": F.size(F.array_distinct(labels)).cast("long"),
            "combined_risk": combined_risk(labels),
        }
    ).withColumn("re_identifiable", F.col("combined_risk") >= 4)


def k_anonymity(records: DataFrame, quasi: list[str], threshold: int = 5) -> DataFrame:
    """One row: k, group_count, record_count, smallest_group (its values, least first among equals) and
    satisfies_threshold. No records give k = 0; no quasi keys make one group of all. Missing values
    group together."""
    groups = records.groupBy(*quasi).agg(F.count("*").alias("n")) if quasi else records.agg(F.count("*").alias("n")).where("n > 0")
    values = F.array(*[F.coalesce(F.col(q).cast("string"), F.lit("")) for q in quasi]) if quasi else F.array().cast("array<string>")
    out = groups.agg(
        F.coalesce(F.min("n"), F.lit(0)).cast("long").alias("k"),
        F.count("*").alias("group_count"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("record_count"),
        F.array_join(F.min(F.struct("n", values.alias("v")))["v"], "|").alias("smallest_group"),
    )
    return out.withColumn("satisfies_threshold", (F.col("k") >= threshold) | ((F.col("record_count") > 0) & F.lit(not quasi)))
