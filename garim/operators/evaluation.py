"""Precision, recall and F1 of predicted spans, form matching, leakage and frequent false positives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garim.functions import checks as C
from garim.functions.ordered import with_running


def _rates(df: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    df = df.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return df.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def by_label(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) over spans (doc_id, label, start, end); a predicted span
    is right if it overlaps a gold one of its text and label, a gold one is missed if none overlaps it."""
    g, p = gold.alias("g"), predicted.alias("p")
    meet = (F.col("g.doc_id") == F.col("p.doc_id")) & (F.col("g.label") == F.col("p.label"))
    meet = meet & (F.col("g.start") < F.col("p.end")) & (F.col("p.start") < F.col("g.end"))
    right = p.join(g, meet, "left_semi").groupBy("label").agg(F.count("*").alias("tp"))
    wrong = p.join(g, meet, "left_anti").groupBy("label").agg(F.count("*").alias("fp"))
    missed = g.join(p, meet, "left_anti").groupBy("label").agg(F.count("*").alias("fn"))
    out = right.join(wrong, "label", "full").join(missed, "label", "full").na.fill(0, ["tp", "fp", "fn"])
    return _rates(out)


def overall(labels: DataFrame) -> DataFrame:
    """One row of micro rates and the macro F1 of `by_label`'s rows."""
    return _rates(labels.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1")))


def forms_match(a: Column, b: Column) -> Column:
    """Equal, or one holds the other and the shorter has two characters or more."""
    return (a == b) | ((a.contains(b) | b.contains(a)) & (F.least(F.length(a), F.length(b)) >= 2))


def leakage(train: DataFrame, test: DataFrame) -> DataFrame:
    """Distinct texts (white space collapsed) that stand in both."""
    key = F.trim(F.regexp_replace("text", r"\s+", " ")).alias("key")
    return train.select(key).join(test.select(key), "key", "left_semi").distinct()


def frequent(spans: DataFrame, known: DataFrame, most: int, least: int = 2) -> DataFrame:
    """The most frequent span texts (label, text, n) that are no known ones; ties in order of text."""
    rest = spans.join(known, ["label", "text"], "left_anti")
    return rest.groupBy("label", "text").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "label", "text").limit(most)


def restricted(labels: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """`overall` of those rows of `by_label` whose label every detector under comparison knows."""
    return overall(labels.where(F.col("label").isin(*wanted)))


def compared(labels: DataFrame, uncounted: tuple[str, ...]) -> DataFrame:
    """(detector, tp, fp, fn, precision, recall, f1, n_uncounted) of rows of `by_label` with a detector's name; finds of
    the uncounted labels are told but count for no rate."""
    counts = F.col("label").isin(*uncounted)
    sums = [F.coalesce(F.sum(F.when(~counts, F.col(c))), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]
    return _rates(labels.groupBy("detector").agg(*sums, F.coalesce(F.sum(F.when(counts, F.col("tp") + F.col("fp"))), F.lit(0)).alias("n_uncounted")))


def thresholds(scored: DataFrame, at: tuple[float, ...] = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7)) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1, skipped) of (score, label) at each threshold; every row is counted
    for all of them in one pass."""
    sums = []
    for i, t in enumerate(at):
        hit = F.col("score") >= t
        sums += [F.count_if(hit & (F.col("label") == 1)).alias(f"tp{i}"), F.count_if(hit & (F.col("label") == 0)).alias(f"fp{i}")]
        sums += [F.count_if(~hit & (F.col("label") == 1)).alias(f"fn{i}"), F.count_if(~hit).alias(f"skip{i}")]
    one = scored.where("score is not null and label in (0, 1)").agg(F.count("*").alias("n"), *sums)
    rows = [F.struct(F.lit(t).alias("threshold"), *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "fn")], (F.col(f"skip{i}") / F.greatest(F.col("n"), F.lit(1))).alias("skipped")) for i, t in enumerate(at)]
    return _rates(one.select(F.inline(F.array(*rows))))


def auc(scored: DataFrame) -> DataFrame:
    """(n_positive, n_negative, auc) of (score, label): the share of pairs of a positive and a negative whose positive scores higher, ties
    by half. Exact: equal scores are counted first, and how many negatives lie below comes from ranges and their sums. Null
    scores and other labels are left out; auc is null without both labels."""
    known = scored.where("score is not null and label in (0, 1)")
    counts = known.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    placed = with_running(counts, ["score"], {"below": F.col("neg")})
    won = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    one = placed.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_positive"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_negative"), won.alias("won"))
    return one.select("n_positive", "n_negative", F.try_divide("won", F.col("n_positive") * F.col("n_negative")).alias("auc"))


def operating_point(scored: DataFrame, recall: float, steps: int = 200) -> DataFrame:
    """Of `steps` thresholds that keep this recall the one of the best precision, the least among equals; no row if none does."""
    grid = tuple(i / steps for i in range(1, steps))
    return thresholds(scored, grid).where(F.col("recall") >= recall).orderBy(F.desc("precision"), "threshold").limit(1)


def first_longest(spans: Column) -> Column:
    """Spans by start, the longest first among equals; what begins before the end of the last one kept is dropped."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("k"), s.alias("span"))))
    none = F.filter(spans, lambda s: F.lit(False))
    return F.aggregate(
        F.transform(keyed, lambda k: k["span"]), none, lambda kept, s: F.when((F.size(kept) > 0) & (F.element_at(kept, -1)["end"] > s["start"]), kept).otherwise(F.concat(kept, F.array(s)))
    )


def relabelled(spans: DataFrame, names: dict[str, str], least: float = 0.0) -> DataFrame:
    """Another detector's (label, text, score) under our labels: residents and foreigners by the seventh digit of a
    number of the shape 6-7 (others go), names that are not mapped and scores below `least` left out."""
    seventh = F.regexp_extract("text", "^[0-9]{6}-([0-9])", 1)
    person = F.when(seventh.isin("5", "6", "7", "8"), "FRN").when(seventh != "", "RRN")
    mapped = F.when(F.col("label") == "RRN_OR_FRN", person)
    for theirs, ours in names.items():
        mapped = mapped.when(F.col("label") == theirs, ours)
    return spans.where(F.col("score") >= least).withColumn("label", mapped).where("label is not null")


def long_persons(spans: DataFrame, least: int = 3) -> DataFrame:
    """Spans without persons whose name has fewer characters."""
    return spans.where((F.col("label") != "PERSON") | (F.length("text") >= least))


def verified(label: Column, text: Column) -> Column:
    """Whether an identifier that a model found has the digits of one; other labels pass."""
    d = C.digits(text)
    number = d.try_cast("long")
    card = F.length(d).between(13, 19) & d.rlike("^[23459]") & C.luhn_valid(d)
    return (
        F.when(label == "CARD", card)
        .when(label == "BUSINESS_REG", (F.length(d) == 10) & C.business_valid(number))
        .when(label == "CORP_REG", (F.length(d) == 13) & C.corporate_valid(number))
        .otherwise(True)
    )


def known_pairs(pairs: DataFrame, known: DataFrame, first: str, second: str) -> DataFrame:
    """pairs with `valid`: whether (first, second), say province and district or agency and title, stands in the table
    `known`. Null parts are never valid. A join on both keys; Spark broadcasts the table if it is small."""
    marks = known.select(F.col(first).alias("_a"), F.col(second).alias("_b")).distinct().withColumn("_known", F.lit(True))
    out = pairs.join(marks, (F.col(first) == F.col("_a")) & (F.col(second) == F.col("_b")), "left")
    return out.withColumn("valid", F.coalesce("_known", F.lit(False))).drop("_a", "_b", "_known")
