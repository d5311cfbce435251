"""Detection, policy and replacement in one call, for texts and for records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garim.functions import spans as S
from garim.functions.normalize import detect_normalized
from garim.functions.spans import exploded
from garim.operators import masking, tabular, vault
from garim.operators.fpe import disguised

STRATEGIES = ("tokenize", *masking.STRATEGIES, "fpe")
#: Strategies whose values can be told from a table of what stood for what.
RECORDED = ("tokenize", "hashed", "fpe")


def _value(label: Column, value: Column, strategy: str, salt: str) -> Column:
    return disguised(label, value, salt) if strategy == "fpe" else masking.substitute(label, value, strategy, salt)


def anonymize(
    df: DataFrame, mode: str = "STRICT", strategy: str = "tokenize", salt: str = "", key: str = "doc_id", text: str = "text", name: str = "text_out", **options
) -> tuple[DataFrame, DataFrame | None]:
    """df with `spans` (with actions) and its text with blocked spans replaced, and for `RECORDED` strategies the vault
    (key, label, original, token). Spans are found in normalised text. Null text stays null."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    found = masking.with_actions(detect_normalized(df, text, "spans", **options), mode)
    long = exploded(found, key).where("s.action = 'BLOCK'").select(key, "s.label", "s.text", "s.start", "s.risk_level")
    entries = vault.entries(long, key) if strategy in RECORDED else None
    if strategy == "tokenize":
        return vault.tokenize(found, entries, key, text, name=name), entries
    blocked = F.filter("spans", lambda s: s["action"] == "BLOCK")
    replaced = S.splice(F.col(text), blocked, lambda s: _value(s["label"], s["text"], strategy, salt))
    out = found.withColumn(name, F.when(F.size(blocked) > 0, replaced).otherwise(F.col(text)))
    if entries is not None:
        entries = entries.withColumn("token", _value(F.col("label"), F.col("original"), strategy, salt))
    return out, entries


def anonymize_records(records: DataFrame, strategy: str = "redact", columns: dict[str, str] | None = None, salt: str = "", values: str | None = None) -> DataFrame:
    """records with the cells of labelled columns replaced. Records of unlike keys come as a map column `values`: its
    keys are labelled like headers, one by one. Empty and null cells and unlabelled ones stay."""
    if values is None:
        if strategy == "fpe":
            known = tabular.map_columns(records.columns) if columns is None else columns
            kept = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
            return records.withColumns({c: F.when(kept(c), F.col(c)).otherwise(disguised(F.lit(label), F.col(c).cast("string"), salt)) for c, label in known.items()}) if known else records
        return tabular.mask_columns(records, strategy, columns, salt)
    label = tabular.label_of

    def cell(header: Column, value: Column) -> Column:
        return F.when((F.coalesce(value, F.lit("")) == "") | label(header).isNull(), value).otherwise(_value(label(header), value, strategy, salt))

    return records.withColumn(values, F.transform_values(values, cell))


def totals(results: DataFrame) -> DataFrame:
    """One row over results (error, total, blocked, review) of a batch: texts that went through and that failed, and the
    sums of the former."""
    done = F.col("error").isNull()
    sums = [F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("long").alias(c) for c in ("total", "blocked", "review")]
    return results.agg(F.count_if(done).alias("succeeded"), F.count_if(~done).alias("failed"), *sums)
