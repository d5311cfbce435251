"""Loaders of labelled corpora, and a seeded generator of texts whose personal data is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garim.functions import checks as C
from garim.operators.sequences import bio_spans

# Labels of the dialogue corpus and ours.
DIALOGUE_LABELS = {
    "PS_NAME": "PERSON", "QT_AGE": "AGE", "OGG_EDUCATION": "EDUCATION", "FD_MAJOR": "MAJOR", "CV_POSITION": "POSITION", "DT_BIRTH": "DT_BIRTH",
    "QT_PHONE": "PHONE", "QT_MOBILE": "PHONE", "TMI_EMAIL": "EMAIL", "TMI_SITE": "URL", "QT_RESIDENT_NUMBER": "RRN", "LC_ADDRESS": "ADDRESS",
    "LCP_COUNTRY": "ADDRESS", "QT_CARD_NUMBER": "CARD", "QT_ACCOUNT_NUMBER": "ACCOUNT", "QT_PASSPORT_NUMBER": "PASSPORT", "QT_DRIVER_NUMBER": "DRIVER_LICENSE",
    "QT_IP": "IP", "QT_ALIEN_NUMBER": "FRN", "QT_PLATE_NUMBER": "VEHICLE", "QT_LENGTH": "HEIGHT", "QT_WEIGHT": "WEIGHT",
}


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, spans of label and text) of a JSON array of sentences with their PII_set; labels that have no
    counterpart are left out. doc_id is a digest of the text."""
    pii = "array<struct<label:string,form:string>>"
    rows = spark.read.schema(f"sentence string, PII_set {pii}").option("multiLine", True).json(path).where("sentence is not null")
    names = F.create_map(*[F.lit(x) for pair in DIALOGUE_LABELS.items() for x in pair])
    mapped = F.transform(F.coalesce("PII_set", F.array().cast(pii)), lambda p: F.struct(F.try_element_at(names, p["label"]).alias("label"), p["form"].alias("text")))
    known = F.filter(mapped, lambda p: p["label"].isNotNull() & p["text"].isNotNull())
    return rows.select(F.xxhash64("sentence").alias("doc_id"), F.col("sentence").alias("text"), F.array_distinct(known).alias("spans"))


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """Spans (doc_id, label, start, end, text, confidence) of a file with a character and its tag on each line; sentences
    end at a blank line, lines that begin with ## are headings. A file is ordered in one task; files are not."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("nth"))
    lines = lines.where(~F.col("value").startswith("##"))
    order = Window.partitionBy("file").orderBy("nth")
    numbered = lines.withColumn("sentence", F.sum((F.trim("value") == "").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    split = F.split("value", "\t", 2)
    chars = numbered.where("value like '%\t%'").select(F.xxhash64("file", "sentence").alias("doc_id"), "nth", split[0].alias("ch"), F.trim(split[1]).alias("tag"))
    placed = chars.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("nth")) - 1)
    return bio_spans(placed.select("doc_id", "pos", "ch", "tag", F.lit(1.0).alias("score")))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, spans) of lines of JSON with a text and its spans (start, end, label)."""
    rows = spark.read.schema("text string, spans array<struct<start:int,end:int,label:string>>").json(path).where("text is not null")
    return rows.select(F.xxhash64("text").alias("doc_id"), "text", F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int,label:string>>)")).alias("spans"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(text) of nested JSON: each record's title and the contexts of its paragraphs, a blank line between."""
    schema = "data array<struct<doc_title:string,paragraphs:array<struct<context:string>>>>"
    records = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("data").alias("r"))
    parts = F.concat(F.array("r.doc_title"), F.coalesce(F.transform("r.paragraphs", lambda p: p["context"]), F.array().cast("array<string>")))
    text = F.array_join(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != "")), "\n\n")
    return records.select(text.alias("text")).where("text <> ''")


def _pad(n: Column, size: int) -> Column:
    return F.lpad(n.cast("string"), size, "0")


def generated(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(doc_id, text, spans of label, text, start, end): n texts, each a template filled with values that hold their
    check digits, the same for a seed. What a text says follows from its number alone, so tasks share nothing."""
    rows = spark.range(n).withColumnRenamed("id", "doc_id")
    draw = lambda salt, below: F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit(salt)), F.lit(below)).cast("long")
    # Column by column, so that no value is worked out twice.
    front = (40 + draw("year", 60)) * 10**11 + (1 + draw("month", 12)) * 10**9 + (1 + draw("day", 28)) * 10**7 + (1 + draw("sex", 2)) * 10**6 + draw("serial", 100000) * 10
    rows = rows.withColumns({"_front": front, "_card": F.concat(F.lit("4"), _pad(draw("card", 10**14), 14)), "_kind": draw("template", 4)})
    fit = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat("_card", d.cast("string"))), C.luhn_valid)[0]
    phone = F.concat_ws("-", F.lit("010"), _pad(2000 + draw("front", 8000), 4), _pad(draw("back", 10000), 4))
    mail = F.concat(F.lit("user"), draw("mail", 100000).cast("string"), F.lit("@example.com"))
    rows = rows.withColumns({"_resident": _pad(F.col("_front") + C.rrn_check(F.col("_front")), 13), "CARD": fit, "PHONE": phone, "EMAIL": mail})
    rows = rows.withColumn("RRN", F.concat_ws("-", F.substring("_resident", 1, 6), F.substring("_resident", 7, 7)))
    values = {label: F.col(label) for label in ("RRN", "PHONE", "EMAIL", "CARD")}
    templates = (
        (("신청인의 주민등록번호는 ", "RRN"), (" 이고 연락처는 ", "PHONE"), (" 입니다.", None)),
        (("결제 카드 ", "CARD"), (" 승인 문의는 ", "EMAIL"), (" 로 보내 주십시오.", None)),
        (("담당 연락처 ", "PHONE"), (", 전자우편 ", "EMAIL"), (".", None)),
        (("안내문에는 개인정보가 없습니다.", None),),
    )

    def filled(parts: tuple) -> Column:
        text, spans = F.lit(""), []
        for words, label in parts:
            text = F.concat(text, F.lit(words))
            if label:
                start = F.length(text)
                spans.append(F.struct(F.lit(label).alias("label"), values[label].alias("text"), start.alias("start"), (start + F.length(values[label])).alias("end")))
                text = F.concat(text, values[label])
        return F.struct(text.alias("text"), (F.array(*spans) if spans else F.array()).cast("array<struct<label:string,text:string,start:int,end:int>>").alias("spans"))

    which, made = F.col("_kind"), None
    for i, parts in enumerate(templates):
        made = F.when(which == i, filled(parts)) if made is None else made.when(which == i, filled(parts))
    return rows.select("doc_id", made.alias("made")).select("doc_id", "made.text", "made.spans")


def injected(docs: DataFrame, values: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with the sentence of `values` (key, label, value) put after the first sentence, and its span in `gold`; texts
    without one stay, with an empty gold."""
    both = docs.join(values.select(key, F.col("label").alias("_label"), F.col("value").alias("_value")), key, "left")
    head = F.regexp_extract("text", r"^(?s)[^.!?\n]*[.!?\n]?", 0)
    start = F.length(head) + 1
    span = F.struct(F.col("_label").alias("label"), F.col("_value").alias("text"), start.alias("start"), (start + F.length("_value")).alias("end"))
    text = F.when(F.col("_value").isNotNull(), F.concat(head, F.lit(" "), F.col("_value"), F.lit("."), F.substring("text", F.length(head) + 1, F.length("text")))).otherwise(F.col("text"))
    gold = F.when(F.col("_value").isNotNull(), F.array(span)).otherwise(F.expr("cast(array() as array<struct<label:string,text:string,start:int,end:int>>)"))
    return both.withColumn("gold", gold).withColumn("text", text).drop("_label", "_value")
