"""Names in context: what a text has said before counts, and how much a word's syllables look like a name's.

Candidates of a text are taken in order. A name that was accepted raises later candidates of the same words by its confidence,
`MOST_RAISED` at most. Then weak candidates rise by `BESIDE` in a sentence that has a strong name, and last, those that are still
weak are held against all names of the text, so that an early mention is found by a later one. The names seen so far are a map whose
keys don't interact, so the fold runs over candidates sorted by words and place and carries one entry of it at a time; the work
grows with the candidates, not with their square.

A syllable model is a table (syllable, n_name, n_other, log_odds), fitted by one aggregation over labelled words. There are no more
than 11,172 syllables, so it is read to the driver and goes into expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garim.functions.spans import NO_SPANS, SPAN, bound, count_below, pieces, running, scan

# Bounds and steps of confidence.
LEAST = 0.5
MOST_RAISED = 0.4
STRONG, BESIDE = 0.7, 0.15
#: Mean likelihoods of the given name's syllables and what they add.
BONUSES = ((0.8, 0.2), (0.5, 0.1), (0.2, 0.05))
MOST_SYLLABLES = 11_172
SENTENCE_END = r"[.!?\n]"


# --- syllables ---------------------------------------------------------------------------------


def labelled_words(docs: DataFrame, label: str = "PERSON") -> DataFrame:
    """(word, is_name) for each run of Hangul in (text, spans of start, end and label); a name's run begins where a span
    of the label does."""
    words = F.regexp_extract_all("text", F.lit("[가-힣]+"), F.lit(0))
    gaps = F.transform(F.split("text", "[가-힣]+", -1), F.length)
    starts = lambda w: F.zip_with(running(F.zip_with(w, F.slice(gaps, F.lit(1), F.size(w)), lambda x, g: F.length(x) + g)), F.slice(gaps, F.lit(1), F.size(w)), lambda at, g: at + g)
    placed = bound(words, lambda w: F.arrays_zip(w.alias("word"), starts(w).alias("start")))
    names = F.transform(F.filter("spans", lambda s: s["label"] == label), lambda s: s["start"])
    return docs.select(F.inline(placed).alias("word", "start"), names.alias("names")).select("word", F.array_contains("names", F.col("start")).alias("is_name"))


def fit_syllables(words: DataFrame) -> DataFrame:
    """(syllable, n_name, n_other, log_odds) of (word, is_name): how often each Hangul syllable after the first stands in names and in
    other words, and the logarithm of the ratio of its shares, each with one added. Null words and flags count nowhere."""
    rest = words.where("word is not null and is_name is not null").select("is_name", F.explode(F.regexp_extract_all(F.expr("substr(word, 2)"), F.lit("[가-힣]"), F.lit(0))).alias("syllable"))
    counts = rest.groupBy("syllable").agg(F.count_if("is_name").alias("n_name"), F.count_if(~F.col("is_name")).alias("n_other"))
    totals = counts.agg(F.sum("n_name").alias("names"), F.sum("n_other").alias("others"), F.count("*").alias("kinds"))
    share = lambda n, total: (F.col(n) + 1) / (F.col(total) + F.col("kinds"))
    # One row, by definition.
    return counts.crossJoin(F.broadcast(totals)).select("syllable", "n_name", "n_other", F.log(share("n_name", "names") / share("n_other", "others")).alias("log_odds"))


@dataclass(frozen=True)
class Syllables:
    """A fitted model in memory: log odds by syllable."""

    odds: tuple[tuple[str, float], ...]

    @classmethod
    def of(cls, fitted: DataFrame) -> Syllables:
        rows = fitted.select("syllable", "log_odds").orderBy("syllable").limit(MOST_SYLLABLES + 1).collect()
        if len(rows) > MOST_SYLLABLES:
            raise ValueError("a model of Hangul syllables has 11,172 rows at most")
        return cls(tuple((r.syllable, float(r.log_odds)) for r in rows))

    def likelihood(self, name: Column) -> Column:
        """The mean probability over the syllables after the first; an unknown one has 0.2. 0 if there is none."""
        keys = "".join(s for s, _ in self.odds)
        places = "".join(chr(0xF0000 + i) for i in range(len(self.odds)))
        values = F.split(F.lit(",".join(str(o) for _, o in self.odds) or "0"), ",").cast("array<double>")  # folded to one literal

        def of(ch: Column) -> Column:
            known = lambda t: F.when(t == ch, F.lit(0.2)).otherwise(1 / (1 + F.exp(-F.get(values, F.ascii(t) - 0xF0000))))
            return bound(F.translate(ch, keys, places) if keys else ch, known)

        scores = F.transform(F.regexp_extract_all(F.substring(name, 2, 100), F.lit("[가-힣]"), F.lit(0)), of)
        return bound(scores, lambda s: F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s)).otherwise(0.0))

    def bonus(self, name: Column) -> Column:
        """What the likelihood adds to a name of two to four syllables that begins with a surname."""
        from garim.operators.detectors import SURNAMES

        def of(score: Column) -> Column:
            out = F.lit(0.0)
            for least, points in reversed(BONUSES):
                out = F.when(score >= least, points).otherwise(out)
            return F.when(F.length(name).between(2, 4) & name.rlike(f"^[{SURNAMES}]"), out).otherwise(0.0)

        return bound(self.likelihood(name), of)


# --- what a text has said before ---------------------------------------------------------------


def _sentences(text: Column, spans: Column) -> Column:
    """For each span the number of sentence ends before it."""
    ends = lambda parts: F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.length(p) + 1)
    places = bound(pieces(text, SENTENCE_END), lambda parts: bound(ends(parts), lambda e: F.zip_with(running(e), e, lambda before, own: before + own)))
    return bound(places, lambda p: F.transform(spans, lambda s: count_below(p, s["start"])))


_CANDIDATE = f"struct<span:{SPAN},base:double,total:double,taken:boolean,sentence:int>"


def _fold(ordered: Column, later: bool) -> Column:
    """One pass over candidates sorted by words and place: earlier names raise, or (`later`) only the best is carried."""
    kind = "struct<c:" + _CANDIDATE + ",best:double>"
    begin = F.struct(F.lit("").alias("word"), F.lit(0.0).alias("best"))

    def step(s: Column, c: Column) -> Column:
        best = F.when(s["word"] == c["span"]["text"], s["best"]).otherwise(0.0)

        def of(before: Column) -> Column:
            total = c["total"] if later else F.least(F.lit(1.0), c["base"] + F.least(F.lit(MOST_RAISED), before))
            taken = c["taken"] if later else total >= LEAST
            now = lambda t: F.when(t["taken"], F.greatest(before, t["total"])).otherwise(before)
            made = c.withField("total", total).withField("taken", taken)
            return bound(made, lambda t: F.struct(F.struct(c["span"]["text"].alias("word"), now(t).alias("best")).alias("state"), F.struct(t.alias("c"), now(t).alias("best")).alias("out")))

        return bound(best, of)

    return scan(ordered, begin, step, kind)


def accumulated(spans: Column, text: Column) -> Column:
    """The candidates that are names, with their confidence, in the order of the text. `confidence` of a candidate is what stands
    around it."""

    def in_sentences(ids: Column) -> Column:
        made = F.zip_with(spans, ids, lambda s, i: F.struct(s.alias("span"), s["confidence"].alias("base"), F.lit(0.0).alias("total"), F.lit(False).alias("taken"), i.alias("sentence")))
        keyed = F.array_sort(F.transform(made, lambda c: F.struct(c["span"]["text"].alias("word"), c["span"]["start"].alias("start"), c.alias("c"))))
        first = F.transform(_fold(F.transform(keyed, lambda k: k["c"]), False), lambda r: r["c"])
        return bound(first, beside)

    def beside(every: Column) -> Column:
        strong = F.array_distinct(F.transform(F.filter(every, lambda c: c["taken"] & (c["total"] >= STRONG)), lambda c: c["sentence"]))

        def raised(ids: Column) -> Column:
            more = lambda c: ~c["taken"] & (c["total"] + BESIDE >= LEAST) & F.array_contains(ids, c["sentence"])
            return F.transform(every, lambda c: F.when(more(c), c.withField("total", F.least(F.lit(1.0), c["total"] + BESIDE)).withField("taken", F.lit(True))).otherwise(c))

        return bound(bound(strong, raised), against_all)

    def against_all(every: Column) -> Column:
        upto, back = _fold(every, True), F.reverse(_fold(F.reverse(every), True))
        both = F.zip_with(upto, back, lambda u, b: F.struct(u["c"].alias("c"), F.greatest(u["best"], b["best"]).alias("best")))

        def last(x: Column) -> Column:
            c, total = x["c"], F.least(F.lit(1.0), x["c"]["base"] + F.least(F.lit(MOST_RAISED), x["best"]))
            again = ~c["taken"] & (x["best"] > 0) & (total >= LEAST)
            return F.when(again, c.withField("total", total).withField("taken", F.lit(True))).otherwise(c)

        kept = F.filter(F.transform(both, last), lambda c: c["taken"])
        placed = F.array_sort(F.transform(kept, lambda c: F.struct(c["span"]["start"].alias("start"), c["span"].withField("confidence", F.round(c["total"], 2)).alias("span"))))
        return F.transform(placed, lambda p: p["span"])

    done = lambda s: F.when(F.size(s) > 0, bound(_sentences(text, s), in_sentences)).otherwise(F.expr(NO_SPANS))
    return bound(spans, done)
