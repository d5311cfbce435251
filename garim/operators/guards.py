"""Guards: credentials, personal data, insults and harmful advice in generated text, and prompts that work against
their instructions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garim.functions import spans as S
from garim.functions.normalize import with_normalized
from garim.operators.detectors import detect

# The public shapes of credentials, by who issues them.
SECRETS = {
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "aws": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "openai": r"(?<![A-Za-z0-9])sk-(?:proj-)?[A-Za-z0-9_-]{20,}",
    "github": r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})",
    "gitlab": r"(?<![A-Za-z0-9])glpat-[A-Za-z0-9_-]{20,}",
    "npm": r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}",
    "hugging_face": r"(?<![A-Za-z0-9])hf_[A-Za-z0-9]{30,}",
    "digital_ocean": r"(?<![A-Za-z0-9])dop_v1_[a-f0-9]{64}",
    "shopify": r"(?<![A-Za-z0-9])shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}",
    "square": r"(?<![A-Za-z0-9])sq0(?:atp|csp)-[A-Za-z0-9_-]{22,}",
    "sendgrid": r"(?<![A-Za-z0-9])SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    "slack": r"https://hooks\.slack\.com/services/[A-Za-z0-9/]{20,}|(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}",
    "telegram": r"(?<![0-9])[0-9]{8,10}:[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])",
    "azure": r"AccountKey=[A-Za-z0-9+/]{40,}={0,2}",
    "bearer": r"(?i:bearer)\s+[A-Za-z0-9._~+/-]{24,}=*",
    "database": r"(?i:(?:jdbc:)?(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:/@]*:[^\s@/]+@[^\s]+)",
}
PLACEHOLDER = r"(?i::(?:password|changeme|passwd|secret|pass|xxx+|\*+|<[^>]*>|\$\{?[A-Z_]+\}?)@|REPLACE_WITH|YOUR[_-]|EXAMPLE)"
#: Labels that say too little about one person to hold text back.
HARMLESS = ("PERSON", "ADDRESS", "MAJOR", "POSITION", "AGE", "HEIGHT", "WEIGHT", "URL", "DOC_ID", "PETITION_ID")


def secret_spans(column: str) -> Column:
    """Spans of credentials, without placeholders; label SECRET_ and who issues them."""
    parts = [S.find_all(column, p, label=f"SECRET_{n.upper()}", risk=5, confidence=0.95, rank=1000 + i) for i, (n, p) in enumerate(SECRETS.items())]
    return F.filter(F.concat(*parts), lambda s: ~s["text"].rlike(PLACEHOLDER))


#: Insults and threats, in words of their own or in the spaced and starred spellings that hide them.
TOXIC = {
    "threat": (4, r"죽여\s*버|죽일\s*거|가만\s*안\s*(?:둬|둘)|칼로\s*찔|(?i:i\s+will\s+kill|going\s+to\s+kill)\s+(?:you|him|her|them)"),
    "slur": (4, r"(?:한남|김치|된장|맘)충|틀딱|급식충|짱깨|쪽바리"),
    "insult": (3, r"[씨시]\s*[이]?\s*[발팔벌]\s*(?:놈|년|새끼)|개\s*[새세]\s*끼|병\s*신\s*(?:아|같|새끼)|미친\s*(?:놈|년|새끼)|(?i:\b(?:idiot|moron|stupid\s+bastard)\b)"),
    "self_harm": (4, r"(?:자살|자해)\s*(?:해|하는\s*(?:법|방법)|하자)|(?i:how\s+to\s+(?:kill|hurt)\s+(?:yourself|myself))"),
}
#: Advice that harms who follows it. A sentence that warns of it is none.
UNSAFE = {
    "medicine": (5, r"(?:약|처방약|인슐린|항생제)\S{0,3}\s*(?:끊|중단하|두\s*배로|임의로\s*(?:늘|줄))\S*|(?i:(?:stop|double)\s+(?:taking\s+)?(?:your\s+)?(?:medication|insulin|antibiotics))"),
    "mixing": (5, r"(?:락스|표백제).{0,12}(?:식초|암모니아|산성).{0,8}(?:섞|혼합)|(?i:mix\s+(?:bleach|ammonia)\s+(?:with|and)\s+(?:bleach|ammonia|vinegar))"),
    "weapon": (5, r"(?:폭탄|폭발물|총기)\S{0,3}\s*(?:만드는|제조|조립)|(?i:how\s+to\s+(?:make|build)\s+(?:a\s+)?(?:bomb|explosives?))"),
    "finance": (4, r"(?:원금|수익)\s*(?:을|이)?\s*(?:무조건\s*)?보장|(?:대출|빚)\S{0,3}\s*(?:받아|내서)\s*(?:투자|주식|코인)|(?i:guaranteed\s+(?:returns?|profits?))"),
    "law": (4, r"(?:증거|기록)\S{0,2}\s*(?:없애|인멸|지우)|세금\S{0,2}\s*(?:안\s*내|빼돌)|(?i:(?:destroy|hide)\s+the\s+evidence)"),
}
WARNING = r"(?:하지|마시|말아|말고|안\s*됩|안\s*돼|금지|위험|주의|불법|never|not|don't|avoid|dangerous|illegal|warning)"


def toxic_spans(column: str) -> Column:
    """Spans of insults, threats and slurs; label TOXIC_ and what they are. Spaces between letters do not hide them."""
    parts = [S.find_all(column, p, label=f"TOXIC_{n.upper()}", risk=risk, confidence=0.9, rank=2000 + i) for i, (n, (risk, p)) in enumerate(TOXIC.items())]
    return F.concat(*parts)


def unsafe_spans(column: str) -> Column:
    """Spans of harmful advice; label UNSAFE_ and its field. A sentence with a word of warning outside the span has none."""
    parts = [S.find_all(column, p, label=f"UNSAFE_{n.upper()}", risk=risk, confidence=0.85, rank=3000 + i) for i, (n, (risk, p)) in enumerate(UNSAFE.items())]
    text = F.col(column)

    def warned(s: Column) -> Column:
        left = F.regexp_extract(S.before(text, s["start"], 60), r"[^.!?\n]*$", 0)
        right = F.regexp_extract(S.after(text, s["end"], 60), r"^[^.!?\n]*", 0)
        return F.concat(left, F.lit("|"), right).rlike(f"(?i){WARNING}")

    return F.filter(F.concat(*parts), lambda s: ~warned(s))


def merged_places(spans: Column) -> Column:
    """(start, end) of runs of spans that overlap or touch, in order."""
    places = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        grown = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(kept) > 0) & (F.element_at(kept, -1)["end"] >= x["start"]), grown).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(places, none, step)


def guard_output(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `violations` (spans), `verdict` (BLOCK from risk 4, else FLAG, or ALLOW) and `safe_text`.
    Null text is allowed and stays null."""
    found = detect(df, text, "_personal", exclude=list(HARMLESS))
    said = F.concat(secret_spans(text), toxic_spans(text), unsafe_spans(text))
    found = found.withColumn("_said", F.coalesce(said, F.expr(S.NO_SPANS))).withColumn("violations", F.concat("_said", "_personal")).drop("_said", "_personal")
    worst = F.array_max(F.transform("violations", lambda v: v["risk_level"]))
    verdict = F.when(worst >= 4, "BLOCK").when(worst.isNotNull(), "FLAG").otherwise("ALLOW")
    redacted = S.splice(F.col(text), merged_places(F.col("violations")), lambda p: F.lit("[REDACTED]"))
    return found.withColumn("verdict", verdict).withColumn("safe_text", F.when(F.size("violations") > 0, redacted).otherwise(F.col(text)))


# Letters of other scripts that look like Latin ones, and digits read as letters.
LOOKALIKES = ("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTXIJSaopvikABEZHIKMNOPTYX")
LEET = (("013457@$!", "oieastasi"), ("013457@$!", "oleastasi"))


def _said(verbs: str, things: str, apart: int, first: str = "") -> str:
    """A verb and a thing in either order, at most so many characters apart; `first` stands right before the thing."""
    thing = rf"(?:{first})\s*(?:{things})" if first else rf"(?:{things})"
    return rf"{thing}.{{0,{apart}}}?(?:{verbs})|(?:{verbs}).{{0,{apart}}}?{thing}"


#: Words of orders that stand in front of a model, in two languages: what they are, which ones, and what is done to them.
_ORDERS = r"지시|지침|명령|규칙|프롬프트|설정|instructions?|prompts?|rules?|directions?|guidelines?|directives?"
_WHICH = r"(?:이전|기존|앞선|앞의|위의|지금까지의?|원래|처음|너의|네|시스템)\s*(?:받은\s*)?(?:모든)?|(?:previous|prior|above|earlier|preceding|initial|your)"
_UNDO = r"무시|잊어|잊고|따르지|버리고|취소|초기화|무효|폐기|덮어|ignore|disregard|forget|override"
_HIDDEN = r"시스템|숨긴|숨겨진|비밀|내부|초기|처음\s*받은|네?가?\s*받은|system|initial|original|hidden|secret"
_TELL = r"알려|보여|출력|말해|공개|복사|읽어|적어|반복|reveal|show|print|repeat|tell|output"
_ALL = r"전체|모든|지금까지의?|위의?|entire|whole|full"
#: Category, risk, pattern; the first four categories block from risk 4.
PROMPT_RULES = (
    ("INSTRUCTION_OVERRIDE", 4, _said(_UNDO, _ORDERS, 16, _WHICH)),
    ("PROMPT_LEAK", 4, _said(_TELL, rf"{_ORDERS}|메시지|messages?", 14, _HIDDEN)),
    ("JAILBREAK", 4, r"\bDAN\b|do\s*anything\s*now|jailbreak|탈옥\s*모드"),
    ("JAILBREAK", 4, r"(?:제한|규제|필터|검열|제약)\s*(?:이|가)?\s*(?:없는|없이|풀린)|(?:without|no)\s+(?:any\s+)?(?:restrictions|filters|censorship|limits)"),
    ("JAILBREAK", 4, _said(r"해제|풀고|끄고|우회|무력화|disable|bypass|turn\s*off", r"안전\s*(?:필터|장치|규칙)|검열|가드레일|guardrails?|safety\s*(?:filters?|rules?)", 8)),
    ("JAILBREAK", 3, r"(?:가상|허구|소설|역할극|fiction|hypothetical).{0,30}?(?:괜찮|상관\s*없|문제\s*없|허용|allowed|harmless)"),
    ("EXFILTRATION", 4, _said(rf"{_TELL}|보내|덤프|dump|send", r"대화|맥락|컨텍스트|기록|conversation|context|history", 18, _ALL)),
    ("ENCODING", 3, _said(r"디코드|디코딩|해독|decode", r"base64|rot13|hex", 20) + r"|(?:%[0-9A-Fa-f]{2}){6,}"),
)
BLOCKING = ("INSTRUCTION_OVERRIDE", "PROMPT_LEAK", "JAILBREAK", "EXFILTRATION")
#: A request to translate such a sentence is no order to follow it.
QUOTED = r"(?:translate|번역)\s*(?:the following|this|다음|아래)?|(?:라는|라고)\s*(?:문장|말|표현).{0,8}?(?:번역|뜻)"


def _readings(text: Column) -> list[Column]:
    """A text as written, with lookalikes as Latin letters, with single letters drawn together, and with digits as letters."""
    latin = F.when(text.rlike("[A-Za-z]"), F.translate(text, *LOOKALIKES)).otherwise(text)
    joined = F.regexp_replace(latin, r"(?<=(?<![A-Za-z가-힣])[A-Za-z가-힣])[ ._*-](?=[A-Za-z가-힣](?![A-Za-z가-힣]))", "")
    return [latin, joined, *(F.translate(F.lower(joined), *pair) for pair in LEET)]


def _any(pattern: str) -> Column:
    return F.exists("_readings", lambda t: t.rlike(f"(?i){pattern}"))


def guard_prompt(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `categories` (sorted names of what was found in any reading) and `verdict`: BLOCK for a blocking
    category of risk 4, FLAG for any other, else ALLOW. What a request to translate quotes is only flagged.
    Null text is allowed and has no categories; columns with these names are replaced."""
    read = with_normalized(df, text, "_normal").withColumn("_readings", F.array(*_readings(F.col("_normal.text"))))
    hits = [F.when(_any(pattern), F.struct(F.lit(name).alias("name"), F.lit(risk).alias("risk"))) for name, risk, pattern in PROMPT_RULES]
    read = read.withColumn("_hits", F.filter(F.array(*hits), lambda h: h.isNotNull()))
    block = F.exists("_hits", lambda h: (h["risk"] >= 4) & h["name"].isin(*BLOCKING)) & ~F.col("_normal.text").rlike(f"(?i){QUOTED}")
    verdict = F.when(block, "BLOCK").when(F.size("_hits") > 0, "FLAG").otherwise("ALLOW")
    names = F.sort_array(F.array_distinct(F.transform("_hits", lambda h: h["name"])))
    return read.withColumn("verdict", verdict).withColumn("categories", names).drop("_normal", "_readings", "_hits")


def _common_run(text: str, context: str) -> tuple[int, int, int]:
    """(length, place in text, place in context) of the longest run of characters that both hold, the first in the text; places
    are -1 where they share none. Binary search on the length: runs of a length are found by their rolling hashes, taken as
    differences of prefix sums, and compared as they stand."""
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for t in (text, context))
    size = max(len(a), len(b))
    base, back = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    powers, inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x)])) for x in (base, back))
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum((x + np.uint64(1)) * powers[: len(x)])]) for x in (a, b)]

    def shared(length: int) -> tuple[int, int] | None:
        left, right = ((s[length:] - s[:-length]) * inverse[: len(s) - length] for s in sums)
        order = np.argsort(right, kind="stable")
        right = right[order]
        at = np.minimum(np.searchsorted(right, left), len(right) - 1)
        for i in np.flatnonzero(right[at] == left):
            j = at[i]
            while j < len(right) and right[j] == left[i]:
                if text[i : i + length] == context[order[j] : order[j] + length]:
                    return int(i), int(order[j])
                j += 1
        return None

    low, high, found = 0, min(len(a), len(b)), (-1, -1)
    while low < high:
        middle = (low + high + 1) // 2
        places = shared(middle)
        low, high, found = (middle, high, places) if places else (low, middle - 1, found)
    return low, *found


_RUN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("length", "start", "context_start")])


@F.pandas_udf(_RUN)
def common_run(texts: pd.Series, contexts: pd.Series) -> pd.DataFrame:
    """The longest run that a text shares with a context, and its places. Null has none: length 0, places -1."""
    rows = [_common_run(t or "", c or "") for t, c in zip(texts, contexts, strict=True)]
    return pd.DataFrame(rows, columns=["length", "start", "context_start"])


def leaked_run(text: Column, context: Column, least: int = 30) -> Column:
    """As `common_run` where it has at least `least` characters; otherwise null."""
    run = common_run(text, context)
    return F.transform(F.array(run), lambda r: F.when(r["length"] >= least, r))[0]


def repeats_context(text: Column, context: Column, least: int = 30) -> Column:
    """Whether text holds a run of at least `least` characters of the context. Null has none."""
    return common_run(text, context)["length"] >= least
