"""Queries of offset maps, names in context, dictionaries, exact AUC, shared runs, vaults over batches, audit replay and chunked
tags, and the SQL that gives the same rows.

As in `lens`, sentences are made from the keys of the tables, and what must come out follows from them by arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garim.functions.normalize import detect_normalized
from garim.functions.spans import exploded
from garim.operators import dictionary, evaluation, guards, name_context, sequences, vault
from garim.operators.detectors import detect

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return exploded(df, key).select(key, F.col("s.text").alias("value"), F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"), F.round("s.confidence", 2).alias("confidence"))


# --- texts with breaks, and the places in them ---------------------------------------------------

_FOUR = "lpad(cast({} % 10000 as string), 4, '0')"
_K4, _C4 = _FOUR.format("o_orderkey"), _FOUR.format("o_custkey")


def _apart(digits: str) -> str:
    return " || ' ' || ".join(f"substr({digits}, {i}, 1)" for i in range(1, 5))


#: A sign that becomes three characters, a word that a line's end cuts, a number in boxes, one of wide digits with a mark in it.
_SPACED = f"'0 1 0 - ' || {_apart(_K4)} || ' - ' || {_apart(_C4)}"
_WIDE = f"'０１０-' || {_K4} || '​-' || {_C4}"
_BROKEN = f"'㈜가나 번\n호 ' || {_SPACED} || ' 과 ' || {_WIDE} || ' 끝'"


def source_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones in texts that need both the repair of fields and lines and Unicode normalisation, where the source has them."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_BROKEN).alias("text"))
    return _long(detect_normalized(rows, include=["PHONE"], repair_lines=True))


# --- names ---------------------------------------------------------------------------------------

_NAME = "case o_orderkey % 3 when 0 then '홍길동' when 1 then '남궁민수' else '김철수' end"
_OTHER = "case o_custkey % 2 when 0 then '이영희' else '박민준' end"
_NAMED = (
    f"case o_orderkey % 4 when 0 then {_NAME} || '는 갔다. 성명: ' || {_NAME} when 1 then '성명: ' || {_NAME} || '. ' || {_OTHER} || '는 옴'"
    f" when 2 then '성명: ' || {_NAME} || '. ' || {_NAME} || '도 옴' else {_OTHER} || '는 갔다' end"
)


def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are said again, before and after the place that tells them, and others that only look like names."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_NAMED).alias("text"))
    return _long(detect(rows, include=["PERSON"]))


_WORDS = ("홍길동", "김철수", "이영희", "박민준", "남궁민수", "나라", "바나나", "동네", "철도", "민수용")
_WORD = "case o_custkey % 10 " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(_WORDS)) + " end"


def syllable_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllables of words that orders hold as names, half of the customers' being mistaken."""
    words = _table(spark, sf_dir, "orders").select(F.expr(_WORD).alias("word"), F.expr("o_custkey % 10 < 5 and o_orderkey % 4 <> 0").alias("is_name"))
    return name_context.fit_syllables(words).withColumn("log_odds", F.round("log_odds", 6))


# --- dictionaries --------------------------------------------------------------------------------


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, nations = _table(spark, sf_dir, "region"), _table(spark, sf_dir, "nation")
    inside = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("term"), F.col("r_name").alias("parent"))
    return regions.select(F.col("r_name").alias("term"), F.lit(None).cast("string").alias("parent")).union(inside)


def nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers behind a region that holds them or another; one that goes on from other letters is none."""
    customers = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = customers.join(_table(spark, sf_dir, "region"), F.col("c_custkey") % 5 == F.col("r_regionkey"))
    text = F.expr("'in ' || r_name || ' ' || n_name || ', not ' || r_name || ' X' || n_name")
    found = dictionary.known_pairs(rows.select("c_custkey", text.alias("text")), _places(spark, sf_dir))
    return found.select("c_custkey", "first", "second", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "valid")


def school_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools that a table names, among names that only hold one of them."""
    nations = _table(spark, sf_dir, "nation")
    schools = dictionary.Terms.of(nations.select(F.concat("n_name", F.lit("대학교")).alias("term")))
    rows = _table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.expr("'졸업 ' || n_name || '대학교, 새' || n_name || '대학교 ' || n_name || '대학교생'")
    return _long(detect(rows.select("c_custkey", text.alias("text")), include=["EDUCATION"], dictionaries={"EDUCATION": schools}), "c_custkey")


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often long words of the benchmark stand in all documents: a trie, or an automaton where there are thousands."""
    words = _table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("term"))
    found = dictionary.with_terms(_table(spark, sf_dir, "documents").select("text"), dictionary.Terms.of(words, "A-Za-z"))
    return found.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("n"))


# --- evaluation ----------------------------------------------------------------------------------


def score_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _table(spark, sf_dir, "labels").select(((F.col("doc_id") * 7 + F.col("toxic") * 20) % 100 / 100.0).alias("score"), F.col("toxic").alias("label"))
    return evaluation.auc(scored).withColumn("auc", F.round("auc", 9))


def leakage_between_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents with an odd id that stand among those with an even one too."""
    docs = _table(spark, sf_dir, "documents")
    return evaluation.leakage(docs.where("doc_id % 2 = 0").select("text"), docs.where("doc_id % 2 = 1").select("text"))


# --- runs of a context ---------------------------------------------------------------------------

_CONTEXT = "md5(cast(o_orderkey as string)) || md5('c' || cast(o_custkey as string)) || md5('d' || cast(o_orderkey as string))"


def context_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of its context that an answer repeats; fewer than 30 characters are none."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_CONTEXT).alias("context"), F.expr("cast(1 + o_custkey % 20 as int)").alias("a"), F.expr("cast(25 + o_orderkey % 30 as int)").alias("n"))
    answers = rows.withColumn("text", F.concat(F.lit("답변 zz"), F.col("context").substr(F.col("a"), F.col("n")), F.lit("zz")))
    run = guards.leaked_run(F.col("text"), F.col("context"))
    found = answers.select("o_orderkey", run.alias("r")).where("r is not null")
    return found.select("o_orderkey", *[F.col(f"r.{c}").cast("long").alias(c) for c in ("length", "start", "context_start")])


# --- vaults and logs -----------------------------------------------------------------------------


def vault_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers in two batches, the second of which comes twice."""
    seen = _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("label"), F.col("c_name").alias("original"), F.col("c_custkey").alias("at"))
    empty = spark.createDataFrame([], "label string, original string, token string")
    first = vault.merged(empty, seen.where("at % 3 = 0"), ["at"])
    second = vault.merged(first, seen.where("at % 5 <> 0"), ["at"])
    return vault.merged(second, seen.where("at % 5 <> 0"), ["at"])


def audit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a log says of each token when it is replayed over a state that has a part of it already."""
    events = _table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.expr("case o_orderkey % 3 when 0 then 'mask' when 1 then 'reveal' else 'store' end").alias("action"),
        F.expr("'<C_' || o_custkey || '>'").alias("token"), F.lit("C").alias("label"), F.expr("'a' || o_orderkey % 2").alias("actor"), F.col("o_orderkey").cast("string").alias("context"),
    )
    key = F.col("context").cast("long")
    state = vault.replayed(events.where(key % 3 == 0))
    out = vault.replayed(events.where(key % 2 == 0), state)
    return out.select("token", "last_action", F.date_format("last_ts", "yyyy-MM-dd").alias("last_day"), F.array_join("actors", ",").alias("actors"), "n_events")


# --- chunks --------------------------------------------------------------------------------------


def chunked_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one return flag within each order, from tags that were made chunk by chunk with some places in common."""
    flags = sequences.first_of_places(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag")
    dealt = sequences.chunks(flags.withColumn("score", F.lit(1.0)), 3, 1)
    # Each chunk begins afresh.
    tagged = dealt.withColumn("tag", F.concat(F.when(F.col("pos") % 3 == 0, "B-").otherwise("I-"), "ch"))
    whole = sequences.carried(sequences.joined_chunks(tagged), 3)
    return sequences.bio_spans(whole).select("doc_id", "label", "start", "end", F.length("text").cast("long").alias("n"))


_PLACED = "select r_regionkey, r_name, n_nationkey, n_name, n_regionkey, c_custkey from customer join nation on c_nationkey = n_nationkey join region on c_custkey % 5 = r_regionkey"
ORACLES = {
    "source_spans": f"""
with o as (select o_orderkey as doc_id, {_SPACED} as a, {_WIDE} as b from orders)
select doc_id, a as value, 8::bigint as start_at, 33::bigint as end_at, 1.0::double as confidence from o
union all select doc_id, b, 36, 50, 1.0 from o""",
    "repeated_names": f"""
with o as (select o_orderkey as doc_id, o_orderkey % 4 as kind, {_NAME} as n from orders),
f as (select doc_id, n as value, 0::bigint as start_at, 0.55::double as confidence from o where kind = 0
  union all select doc_id, n, length(n) + 10, 0.65 from o where kind = 0
  union all select doc_id, n, 4, 0.65 from o where kind in (1, 2)
  union all select doc_id, n, 6 + length(n), 0.55 from o where kind = 2)
select doc_id, value, start_at, start_at + length(value) as end_at, confidence from f""",
    "syllable_odds": f"""
with w as (select {_WORD} as word, o_custkey % 10 < 5 and o_orderkey % 4 <> 0 as is_name from orders),
s as (select unnest(string_split(word[2:], '')) as syllable, is_name from w),
c as (select syllable, count(*) filter (is_name) as n_name, count(*) filter (not is_name) as n_other from s group by 1),
t as (select sum(n_name) as a, sum(n_other) as b, count(*) as k from c)
select syllable, n_name, n_other, round(ln(((n_name + 1) / (a + k)) / ((n_other + 1) / (b + k))), 6) as log_odds from c, t""",
    "nation_pairs": f"""
select c_custkey, r_name as first, n_name as second, 3::bigint as start_at, 4 + length(r_name) + length(n_name) as end_at, n_regionkey = r_regionkey as valid from ({_PLACED})""",
    "school_terms": """
select c_custkey, n_name || '대학교' as value, 3::bigint as start_at, 6 + length(n_name) as end_at, 0.95::double as confidence from customer join nation on c_nationkey = n_nationkey""",
    "term_counts": """
with t as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) as term from benchmark), w as (select unnest(regexp_extract_all(text, '[A-Za-z]+')) as term from documents)
select term, count(*) as n from w join t using (term) group by term""",
    "score_auc": """
with s as (select (doc_id * 7 + toxic * 20) % 100 / 100.0::double as score, toxic as label from labels where toxic in (0, 1)),
c as (select score, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from s group by 1),
w as (select *, sum(neg) over (order by score) - neg as below from c)
select sum(pos)::bigint as n_positive, sum(neg)::bigint as n_negative, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) as auc from w""",
    "leakage_between_halves": r"""
with k as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as key from documents)
select distinct key from k where doc_id % 2 = 0 and key in (select key from k where doc_id % 2 = 1)""",
    "context_runs": """
select o_orderkey, 25 + o_orderkey % 30 as length, 5::bigint as start, o_custkey % 20 as context_start from orders where 25 + o_orderkey % 30 >= 30""",
    "vault_batches": """
with a as (select c_mktsegment as label, c_name as original, min(c_custkey) as seen from customer where c_custkey % 3 = 0 group by all),
first as (select label, original, row_number() over (partition by label order by seen, original) as n from a),
b as (select c_mktsegment as label, c_name as original, min(c_custkey) as seen from customer where c_custkey % 5 <> 0 group by all),
fresh as (select b.* from b left join first using (label, original) where n is null),
more as (select label, original, row_number() over (partition by label order by seen, original) + coalesce((select max(n) from first f where f.label = fresh.label), 0) as n from fresh)
select label, original, '<' || label || '_' || n || '>' as token from (select * from first union all select * from more)""",
    "audit_state": """
with e as (select o_orderdate::timestamp as ts, case o_orderkey % 3 when 0 then 'mask' when 1 then 'reveal' else 'store' end as action, '<C_' || o_custkey || '>' as token,
  'a' || o_orderkey % 2 as actor from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0)
select token, arg_max(action, (ts, action)) as last_action, strftime(max(ts), '%Y-%m-%d') as last_day, string_agg(distinct actor, ',' order by actor) as actors, count(*) as n_events from e group by token""",
    "chunked_islands": """
with l as (select l_orderkey as k, l_linenumber as p, any_value(l_returnflag) as f from lineitem group by all),
g as (select k, p, f, p - row_number() over (partition by k, f order by p) as run from l)
select k as doc_id, f as label, min(cast(p as bigint)) as start, cast(max(p) + 1 as bigint) as "end", count(*) as n from g group by k, f, run""",
}


def queries() -> dict[str, Query]:
    return {name: globals()[name] for name in ORACLES}
