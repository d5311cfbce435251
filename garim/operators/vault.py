"""Reversible tokens as a table: numbering, occurrences, the way back, merging of batches, and the log of its use.

`tokenize` and `restore` hold a scope's tokens in one map, so a scope should be a text or a few; a vault over a whole corpus is
joined by `reveal`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garim.functions.ordered import with_running


def entries(spans: DataFrame, scope: str = "doc_id") -> DataFrame:
    """(scope, label, original, token, first_seen_offset, occurrences, risk_level) of blocked spans in long
    form (scope, label, text, start, risk_level). Tokens count a label's values within the scope in the
    order in which they first appear. A scope is one text, so its window is bounded by that text."""
    grouped = spans.groupBy(scope, "label", F.col("text").alias("original")).agg(
        F.min("start").alias("first_seen_offset"),
        F.sort_array(F.collect_list("start")).alias("occurrences"),
        F.max("risk_level").alias("risk_level"),
    )
    order = Window.partitionBy(scope, "label").orderBy("first_seen_offset")
    number = F.row_number().over(order).cast("string")
    return grouped.withColumn("token", F.concat(F.lit("<"), "label", F.lit("_"), number, F.lit(">")))


def tokenize(df: DataFrame, vault: DataFrame, scope: str = "doc_id", text: str = "text", spans: str = "spans", name: str = "text_out") -> DataFrame:
    """df with each blocked span replaced by its token from the vault."""
    from garim.functions.spans import splice

    tokens = vault.groupBy(scope).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0001", "label", "original"), "token"))).alias("_tokens"))
    joined = df.join(tokens, scope, "left")
    blocked = F.filter(spans, lambda s: s["action"] == "BLOCK")
    replaced = splice(F.col(text), blocked, lambda s: F.col("_tokens")[F.concat_ws("\u0001", s["label"], s["text"])])
    return joined.withColumn(name, F.when(F.col("_tokens").isNull(), F.col(text)).otherwise(replaced)).drop("_tokens")


def reveal(tokens: DataFrame, vault: DataFrame, scope: str = "doc_id") -> DataFrame:
    """tokens (scope, token) with the original of each, or null where the vault has none."""
    return tokens.join(vault.select(scope, "token", "label", "original"), [scope, "token"], "left")


def restore(df: DataFrame, vault: DataFrame, scope: str = "doc_id", text: str = "text_out", name: str = "restored") -> DataFrame:
    """df with every token that the vault knows turned back; others stay."""
    known = vault.groupBy(scope).agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("_known"))
    found = F.regexp_extract_all(F.col(text), F.lit("<[A-Z_]+_[0-9]+>"), F.lit(0))
    between = F.split(F.col(text), "<[A-Z_]+_[0-9]+>", -1)
    back = F.zip_with(between, found, lambda b, t: F.concat(b, F.coalesce(F.col("_known")[t], t, F.lit(""))))
    joined = df.join(known, scope, "left")
    return joined.withColumn(name, F.when(F.col("_known").isNull(), F.col(text)).otherwise(F.array_join(back, ""))).drop("_known")


def highest_numbers(vault: DataFrame) -> DataFrame:
    """(label, highest) by the numbers at the ends of tokens."""
    return vault.groupBy("label").agg(F.max(F.regexp_extract("token", "_([0-9]+)>$", 1).cast("long")).alias("highest"))


def merged(stored: DataFrame, seen: DataFrame, order: list[str]) -> DataFrame:
    """A stored vault (label, original, token) with the values of a batch (label, original, the columns of `order`): values that are there
    keep their tokens, new ones are numbered from their label's highest number on, in the order in which they first appear. A batch
    that was merged before changes nothing. Null labels and values are left out. Ranks come from ranges, so a label may hold
    any share of the values."""
    batch = seen.where("label is not null and original is not null")
    first = batch.groupBy("label", "original").agg(F.min(F.struct(*order)).alias("first"))
    fresh = first.join(stored.select("label", "original"), ["label", "original"], "left_anti").select("label", "original", "first.*")
    placed = with_running(fresh, [*order, "original"], {"before": F.lit(1)}, ["label"])
    numbered = placed.join(highest_numbers(stored), "label", "left")
    number = (F.coalesce("highest", F.lit(0)) + F.col("before") + 1).cast("string")
    token = F.concat(F.lit("<"), "label", F.lit("_"), number, F.lit(">"))
    return stored.select("label", "original", "token").unionByName(numbered.select("label", "original", token.alias("token")))


AUDIT = "ts timestamp, action string, token string, label string, actor string, context string"


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Events of lines of JSON; blank and broken lines are skipped."""
    rows = spark.read.schema(AUDIT + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where("_broken is null and ts is not null and action is not null").drop("_broken")


def replayed(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(token, label, last_action, last_ts, actors, n_events, events) of all events and those behind a state; an event that comes again counts once, so a
    log may be replayed from any place. Of events at one time the action that sorts last is the last."""
    own = F.xxhash64(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "action", "token", "label", "actor", "context")
    each = events.where("token is not null").select("token", own.alias("id"), F.struct("ts", "action", "label", "actor").alias("e"))
    if state is not None:
        each = each.unionByName(state.select("token", F.inline("events")))
    each = each.dropDuplicates(["token", "id"])
    last = F.max(F.struct(F.col("e.ts").alias("ts"), F.col("e.action").alias("action"), F.col("e.label").alias("label")))
    grouped = each.groupBy("token").agg(last.alias("last"), F.sort_array(F.collect_set("e.actor")).alias("actors"), F.count("*").alias("n_events"), F.sort_array(F.collect_list(F.struct("id", "e"))).alias("events"))
    return grouped.select("token", "last.label", F.col("last.action").alias("last_action"), F.col("last.ts").alias("last_ts"), "actors", "n_events", "events")
