"""Queries of names, broken texts, masks, comparisons and mixed sentences, and the SQL that gives the same rows.

As in `lens`, what must come out follows from the keys of the order tables by arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garim.functions import broken, names
from garim.functions.spans import exploded
from garim.operators import anonymizer, evaluation, fpe, masking, review, vault
from garim.operators.detectors import detect
from garim.plans import lens

Query = Callable[[SparkSession, str], DataFrame]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _dealt(spark: SparkSession, sf_dir: str, values: tuple[str, ...]) -> DataFrame:
    """(k, value): the values in turn, one for each order."""
    pick = F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("o_orderkey") % len(values) + 1).cast("int"))
    return _orders(spark, sf_dir).select(F.col("o_orderkey").alias("k"), pick.alias("value"))


def _cases(results: tuple[str, ...]) -> str:
    return "case o_orderkey % {n} {w} end".format(n=len(results), w=" ".join(f"when {i} then '{r}'" for i, r in enumerate(results)))


NAMES = ("홍길동", "남궁민수", "소피마르소", "짐캐리", "류현진", "행정팀")


def romanized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir, NAMES)
    return rows.select("k", names.romanized(F.col("value")).alias("roman"), names.name_origin(F.col("value")).alias("origin"), F.size(names.romanizations(F.col("value"))).cast("long").alias("n_spellings"))


def hanja_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir, ("洪吉童", "南宮民秀", "金英秀", "홍길동", "鮮于賢"))
    return rows.select("k", names.hanja_to_hangul(F.col("value")).alias("name"), names.has_hanja(F.col("value")).alias("had"))


def bare_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir, ("홍길민에게서", "홍길민은", "이", "김철우", "행정실"))
    bare = names.without_particle(F.col("value"))
    return rows.select("k", bare.alias("stem"), names.could_be_name(bare).alias("could_be"), names.full_name(bare, True).alias("full"))


def repaired_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose digits stand apart, and words and numbers that a line's end cuts."""
    key = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    kinds = F.array(
        F.concat(F.lit("번호 "), F.array_join(F.filter(F.split(key, ""), lambda c: c != ""), " "), F.lit(" 끝")),
        F.concat(F.lit("주문\n번호 "), key),
        F.concat(F.lit("tel 010-\n"), key, F.lit("\nx")),
    )
    return _orders(spark, sf_dir).select(F.col("o_orderkey").alias("k"), broken.repaired(F.element_at(kinds, (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("text"))


def _phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.sentences(spark, sf_dir, lens.LENSES["phone"])
    return rows.select("doc_id", F.substring("text", 5, 13).alias("value"))


def partial_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phones(spark, sf_dir).select("doc_id", masking.partial_mask(F.lit("PHONE"), F.col("value")).alias("masked"))


def disguised_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phones(spark, sf_dir).select("doc_id", fpe.disguised(F.lit("PHONE"), F.col("value"), "salt").alias("disguised"))


def disguised_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of a disguised card: its issuer, its length and that its check digit is right."""
    keys = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    out = keys.select("k", F.expr(lens._CARD).alias("value")).withColumn("out", fpe.disguised(F.lit("CARD"), F.col("value"), "salt"))
    return out.select("k", F.substring("out", 1, 6).alias("issuer"), F.length("out").cast("long").alias("size"), F.call_function("luhn_check", F.col("out")).alias("valid"))


def generalized_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = masking.generalize_date(F.col("o_orderdate")).alias("month")
    return _orders(spark, sf_dir).groupBy(months, masking.generalize_date(F.col("o_orderdate"), "decade").alias("decade")).agg(F.count("*").alias("n"))


def verified_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return keys.select("k", evaluation.verified(F.lit("CARD"), F.expr(lens._CARD)).alias("valid"), evaluation.verified(F.lit("BUSINESS_REG"), F.expr(lens._BIZ)).alias("business"))


def known_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a nation lies in the region that its key modulo five names."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    pairs = nation.select("n_name", (F.col("n_nationkey") % 5).alias("asked"))
    known = nation.select(F.col("n_name").alias("place"), F.col("n_regionkey").cast("long").alias("region"))
    return evaluation.known_pairs(pairs.withColumn("asked", F.col("asked").cast("long")), known.select(F.col("place").alias("n_name"), F.col("region").alias("asked")), "n_name", "asked")


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = evaluation.thresholds(labels.select(((F.col("doc_id") % 100) / 100).alias("score"), F.col("toxic").alias("label")))
    return found.select("threshold", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "skipped")])


def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = labels.select(((F.col("toxic") * 30 + F.col("doc_id") % 50) / 100).alias("score"), F.col("toxic").alias("label"))
    return evaluation.operating_point(scored, 0.95, 20).select(F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn")


def _labelled_keys(spark: SparkSession, sf_dir: str, keep: str) -> DataFrame:
    keys = _orders(spark, sf_dir).where(keep)
    label = F.element_at(F.array(F.lit("CARD"), F.lit("PHONE"), F.lit("PERSON")), (F.col("o_custkey") % 3 + 1).cast("int"))
    return keys.select(F.col("o_orderkey").alias("doc_id"), label.alias("label"), F.lit(0).alias("start"), F.lit(5).alias("end"))


def compared_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two detectors that miss every third and every fifth order; persons count for no rate."""
    gold = _labelled_keys(spark, sf_dir, "true")
    rows = None
    for name, keep in (("first", "o_orderkey % 3 <> 0"), ("second", "o_orderkey % 5 <> 0")):
        part = evaluation.by_label(gold, _labelled_keys(spark, sf_dir, keep)).withColumn("detector", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return evaluation.compared(rows, ("PERSON",)).select("detector", "tp", "fp", "fn", F.round("recall", 6).alias("recall"), "n_uncounted")


def overall_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, found = _labelled_keys(spark, sf_dir, "o_orderkey % 7 <> 0"), _labelled_keys(spark, sf_dir, "o_orderkey % 3 <> 0")
    labels = evaluation.restricted(evaluation.by_label(gold, found), ("CARD", "PHONE"))
    return labels.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "macro_f1")])


def matched_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir, ("홍길동", "길동", "동", "김철수"))
    return rows.select("k", evaluation.forms_match(F.col("value"), F.lit("홍길동")).alias("matches"))


def first_longest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as spans; what overlaps one kept before goes."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber <= 2").groupBy("l_orderkey").agg(
        F.collect_list(F.struct((F.col("l_linenumber") * 3).cast("int").alias("start"), (F.col("l_linenumber") * 3 + 1 + F.col("l_orderkey") % 5).cast("int").alias("end"))).alias("spans")
    )
    return lines.select("l_orderkey", F.size(evaluation.first_longest(F.col("spans"))).cast("long").alias("n"))


def relabelled_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _orders(spark, sf_dir).select(
        F.element_at(F.array(F.lit("RRN_OR_FRN"), F.lit("NAME"), F.lit("OTHER")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("label"),
        F.concat(F.lit("900101-"), (F.col("o_custkey") % 10).cast("string"), F.lit("234567")).alias("text"), ((F.col("o_orderkey") % 10) / 10).alias("score"),
    )
    return evaluation.relabelled(spans, {"NAME": "PERSON"}, 0.5).groupBy("label").agg(F.count("*").alias("n"))


def anonymized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of unlike keys: each customer has a name or a phone under a header of its own."""
    people = spark.read.parquet(f"{sf_dir}/customer.parquet")
    odd = F.col("c_custkey") % 2 == 1
    cells = F.when(odd, F.create_map(F.lit("성명"), F.col("c_name"), F.lit("비고"), F.col("c_mktsegment"))).otherwise(F.create_map(F.lit("휴대폰 번호"), F.col("c_name"), F.lit("이메일"), F.lit("")))
    out = anonymizer.anonymize_records(people.select("c_custkey", cells.alias("cells")), "redact", values="cells")
    return out.select("c_custkey", F.explode("cells").alias("header", "value"))


def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _orders(spark, sf_dir).select(
        F.when(F.col("o_orderkey") % 11 == 0, "BadZipFile").alias("error"), (F.col("o_orderkey") % 4).alias("total"), (F.col("o_orderkey") % 2).alias("blocked"), F.lit(1).alias("review")
    )
    return anonymizer.totals(keys)


def mixed_sentence() -> str:
    """A sentence for each order, in SQL."""
    return f"case o_orderkey % 4 {_MIXED} end"


def mixed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with several labels, of which all rules run: a resident's number, a phone, a mail address; a fax's
    number, which a phone of higher risk takes; a number within a longer one."""
    rows = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), F.expr(mixed_sentence()).alias("text"))
    found = detect(rows, include=["RRN", "PHONE", "EMAIL", "FAX", "CARD", "VEHICLE", "BUSINESS_REG"])
    return exploded(found, "doc_id").select("doc_id", "s.label", F.col("s.text").alias("value"), F.col("s.start").cast("long").alias("start_at"))


_KEY7 = "lpad(cast(o_orderkey % 10000000 as string), 7, '0')"
_MIXED = (
    f"when 0 then '전화 010-' || substr({_KEY7}, 1, 4) || '-' || substr({_KEY7}, 4, 4) || ', 메일 u' || {_KEY7} || '@mail.net 차량 12가' || substr({_KEY7}, 4, 4)"
    f" when 1 then '팩스: 번호는   031-200-' || substr({_KEY7}, 4, 4)"
    f" when 2 then '팩스: 번호는 아래와 같음   031-200-' || substr({_KEY7}, 4, 4)"
    f" else '긴 수 99010-' || substr({_KEY7}, 1, 4) || '-' || substr({_KEY7}, 4, 4) || '99'"
)
_MIXED_SQL = f"""
with o as (select o_orderkey, o_orderkey as doc_id, {_KEY7} as s from orders)
select doc_id, 'PHONE' as label, '010-' || substr(s, 1, 4) || '-' || substr(s, 4, 4) as value, cast(3 as bigint) as start_at from o where o_orderkey % 4 = 0
union all select doc_id, 'EMAIL', 'u' || s || '@mail.net', 21 from o where o_orderkey % 4 = 0
union all select doc_id, 'VEHICLE', '12가' || substr(s, 4, 4), 42 from o where o_orderkey % 4 = 0 and substr(s, 4, 4) <> '0000'
union all select doc_id, 'PHONE', '031-200-' || substr(s, 4, 4), 10 from o where o_orderkey % 4 = 1
union all select doc_id, 'PHONE', '031-200-' || substr(s, 4, 4), 17 from o where o_orderkey % 4 = 2
"""


def revealed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the phones in a text, looked up again; one that was never given out is unknown."""
    spans = _phones(spark, sf_dir).select("doc_id", F.lit("PHONE").alias("label"), F.col("value").alias("text"), F.lit(4).alias("start"), F.lit(4).alias("risk_level"))
    asked = spans.select("doc_id", F.explode(F.array(F.lit("<PHONE_1>"), F.lit("<PHONE_2>"))).alias("token"))
    return vault.reveal(asked, vault.entries(spans)).select("doc_id", "token", "original")


def feedback_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that reviewers marked as no person, which detectors may leave out from then on."""
    spans = _dealt(spark, sf_dir, ("우리", "홍길동", "오늘")).select(F.col("k").alias("doc_id"), F.lit("PERSON").alias("label"), F.col("value").alias("text"), F.lit(0).alias("start"), F.lit("REVIEW").alias("action"))
    queue = review.enqueue(spans)
    done = review.mark(queue, queue.where("text <> '홍길동'").select("id", F.lit("FP").alias("verdict")))
    out = review.feedback(done)
    return out.toDF("kind", "word")


ORACLES = {
    "romanized_names": f"select o_orderkey as k, {_cases(('Hong Gildong', 'Namgung Minsu', 'So Pimareuso', 'Jim Kae Ri', 'Ryu Hyeonjin', 'Haeng Jeong Tim'))} as roman,"
    f" {_cases(('korean', 'korean', 'foreign', 'foreign', 'korean', 'unknown'))} as origin, case when o_orderkey % 6 in (3, 5) then 1 else 8 end::bigint as n_spellings from orders",
    "hanja_names": f"select o_orderkey as k, {_cases(('홍길동', '남궁민수', '김영수', '홍길동', '선우현'))} as name, o_orderkey % 5 <> 3 as had from orders",
    "bare_names": f"select o_orderkey as k, {_cases(('홍길민', '홍길민', '이', '김철우', '행정실'))} as stem, o_orderkey % 5 in (0, 1, 3) as could_be, o_orderkey % 5 in (0, 1, 3) as full from orders",
    "repaired_fields": "select o_orderkey as k, case o_orderkey % 3 when 0 then '번호 ' || d || ' 끝' when 1 then '주문번호 ' || d else 'tel 010- ' || d || ' x' end as text"
    " from (select o_orderkey, lpad(cast(o_orderkey as string), 8, '0') as d from orders)",
    "partial_phones": "select o_orderkey as doc_id, '010-****-' || lpad(cast(o_custkey % 10000 as string), 4, '0') as masked from orders",
    "disguised_phones": """
with v as (select o_orderkey as k, '010-' || lpad(cast(o_orderkey % 10000 as string), 4, '0') || '-' || lpad(cast(o_custkey % 10000 as string), 4, '0') as value from orders),
c as (select k, value, unnest(range(0, 13)) as i from v)
select k as doc_id, string_agg(case when i < 3 or value[i + 1] = '-' then value[i + 1] else cast(cast('0x' || sha256('salt:PHONE:' || value || ':' || i)[1:8] as bigint) % 10 as string) end, '' order by i) as disguised
from c group by k""",
    "disguised_cards": "select o_orderkey as k, substr('4' || lpad(cast(o_orderkey % 10000000 as string), 7, '0'), 1, 6) as issuer, 16::bigint as size, true as valid from orders",
    "generalized_dates": "select strftime(o_orderdate, '%Y-%m') as month, (year(o_orderdate) // 10 * 10) || '년대' as decade, count(*) as n from orders group by all",
    "verified_cards": f"""
with v as (select o_orderkey as k, o_custkey as c from orders), w as (select k, {lens._CARD} as d, {lens._BIZ} as b from v), x as (select k, d, b from w)
select k, ({lens._LUHN}) % 10 = 0 as valid, {lens._BIZ_OK.replace("(d,", "(b,")} as business from x""",
    "known_nations": "select n_name, cast(n_nationkey % 5 as bigint) as asked, n_nationkey % 5 = n_regionkey as valid from nation",
    "threshold_sweep": """
with s as (select (doc_id % 100) / 100.0::double as score, toxic as label from labels where toxic in (0, 1)), t(threshold) as (values (0.2::double), (0.3), (0.4), (0.5), (0.6), (0.7)),
c as (select threshold, count(*) filter (score >= threshold and label = 1) as tp, count(*) filter (score >= threshold and label = 0) as fp,
  count(*) filter (score < threshold and label = 1) as fn, avg((score < threshold)::int) as skipped from s, t group by 1)
select threshold, tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round(skipped, 6) as skipped from c""",
    "operating_points": """
with s as (select (toxic * 30 + doc_id % 50) / 100.0::double as score, toxic as label from labels where toxic in (0, 1)), t as (select unnest(range(1, 20)) / 20.0::double as threshold),
c as (select threshold, count(*) filter (score >= threshold and label = 1) as tp, count(*) filter (score >= threshold and label = 0) as fp, count(*) filter (score < threshold and label = 1) as fn from s, t group by 1)
select round(threshold, 6) as threshold, tp, fp, fn from c where tp / (tp + fn) >= 0.95 order by tp / (tp + fp) desc, threshold limit 1""",
    "compared_detectors": """
with g as (select o_orderkey as k, o_custkey % 3 as l from orders), d(detector, m) as (values ('first', 3), ('second', 5))
select detector, count(*) filter (l < 2 and k % m <> 0) as tp, 0::bigint as fp, count(*) filter (l < 2 and k % m = 0) as fn,
  round(count(*) filter (l < 2 and k % m <> 0) / count(*) filter (l < 2), 6) as recall, count(*) filter (l = 2 and k % m <> 0) as n_uncounted from g, d group by detector""",
    "overall_rates": """
with c as (select o_custkey % 3 as l, count(*) filter (o_orderkey % 7 <> 0 and o_orderkey % 3 <> 0) as tp, count(*) filter (o_orderkey % 7 = 0 and o_orderkey % 3 <> 0) as fp,
  count(*) filter (o_orderkey % 7 <> 0 and o_orderkey % 3 = 0) as fn from orders where o_custkey % 3 < 2 group by 1),
s as (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, avg(2 * tp / (2 * tp + fp + fn)) as macro_f1 from c)
select tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round(macro_f1, 6) as macro_f1 from s""",
    "matched_forms": "select o_orderkey as k, o_orderkey % 4 in (0, 1) as matches from orders",
    "first_longest_spans": """
select l_orderkey, case when l_orderkey % 5 >= 3 then 1 else count(distinct l_linenumber) end::bigint as n from lineitem where l_linenumber <= 2 group by l_orderkey""",
    "relabelled_spans": """
select label, count(*) as n from (select case o_orderkey % 3 when 0 then case when o_custkey % 10 in (5, 6, 7, 8) then 'FRN' else 'RRN' end when 1 then 'PERSON' end as label from orders where o_orderkey % 10 >= 5)
where label is not null group by label""",
    "anonymized_records": """
select c_custkey, '성명' as header, '[성명]' as value from customer where c_custkey % 2 = 1
union all select c_custkey, '비고', c_mktsegment from customer where c_custkey % 2 = 1
union all select c_custkey, '휴대폰 번호', '[전화번호]' from customer where c_custkey % 2 = 0
union all select c_custkey, '이메일', '' from customer where c_custkey % 2 = 0""",
    "batch_totals": """
select count(*) filter (o_orderkey % 11 <> 0) as succeeded, count(*) filter (o_orderkey % 11 = 0) as failed, sum(o_orderkey % 4) filter (o_orderkey % 11 <> 0)::bigint as total,
  sum(o_orderkey % 2) filter (o_orderkey % 11 <> 0)::bigint as blocked, count(*) filter (o_orderkey % 11 <> 0) as review from orders""",
    "mixed_spans": _MIXED_SQL,
    "revealed_tokens": """
select o_orderkey as doc_id, token, case token when '<PHONE_1>' then '010-' || lpad(cast(o_orderkey % 10000 as string), 4, '0') || '-' || lpad(cast(o_custkey % 10000 as string), 4, '0') end as original
from orders, (values ('<PHONE_1>'), ('<PHONE_2>')) t(token)""",
    "feedback_words": "select distinct 'common_word' as kind, case o_orderkey % 3 when 0 then '우리' else '오늘' end as word from orders where o_orderkey % 3 <> 1",
}


def queries() -> dict[str, Query]:
    return {name: globals()[name] for name in ORACLES}
