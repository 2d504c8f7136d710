"""Quality rules whose cutoffs are chosen under risk control, in DataFrame functions alone.

Each text has counts (words, characters in words, symbols, repeated lines, repeated words, capitals) and, from
these, a share in thousandths for each rule. Base rules are fixed. The other cutoffs come from labelled texts: in
each stratum and for each rule, cutoffs are tested from the most lenient on, and the strictest is taken for which
all tests so far show, by the exact binomial tail, that at most RISK / rules of the good texts are rejected. The
tests of one sequence need no correction among themselves; strata and rules are corrected for by Bonferroni, so
all guarantees hold together with confidence 1 - DELTA. A stratum with too few labels rejects nothing by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import keep

#: Good texts of a stratum that the rules together may reject at most; the chance that any guarantee fails.
RISK, DELTA = 0.02, 0.05
RULES = ("symbols", "lines", "repeats", "capitals")
#: Steps between cutoffs, in thousandths.
STEP = 10
_BLANK = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _next(x: Column) -> Column:
    return F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1)))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more, the first included."""

    def covered(tri):
        pairs = F.array_sort(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        marks = _let(pairs, lambda p: F.flatten(F.zip_with(p, _next(p), lambda a,
            b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))))
        spots = F.array_sort(F.array_distinct(marks))
        return _let(spots, lambda s: F.aggregate(F.zip_with(s, _next(s), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda x, y: x + y))

    def count(tri):
        equal = _let(F.array_sort(tri), lambda s: F.exists(F.zip_with(s, _next(s), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False))))
        return F.when(equal, covered(tri)).otherwise(0)

    def windows(h):
        two = F.zip_with(h, _next(h), lambda a, b: F.xxhash64(a, b))
        three = F.zip_with(two, F.slice(h, F.lit(3), F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))
        return F.slice(three, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(_let(hashed, windows), count)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, shares) of docs (doc_id, text, lang)."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("stratum"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(
        "doc_id", "stratum",
        F.struct(
            F.length(F.regexp_replace("text", _BLANK, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("line"),
            _let(F.filter(F.split("text", _BLANK), lambda w: w != ""),
                lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeat"))).alias("word"),
            F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("long").alias("capitals"),
        ).alias("m"),
    )
    m = lambda x: F.col(f"m.{x}")
    share = lambda a, b: F.least(F.lit(1000), F.floor(1000 * m(a) / F.greatest(m(b), F.lit(1)))).cast("int")
    failed = (m("word.n") < 50) | (100 * m("word.repeat") > 50 * m("word.n"))
    shares = F.struct(share("n_symbols", "word_chars").alias("symbols"), share("line.dup", "line.lines").alias("lines"),
        share("word.repeat", "word.n").alias("repeats"), share("capitals", "word_chars").alias("capitals"))
    return out.select("doc_id", "stratum", m("word.n").alias("n_words"), "m.word_chars", "m.n_symbols", m("line.dup").alias("n_dup_lines"),
        m("word.repeat").alias("n_repeat_words"), failed.alias("base_failed"), shares.alias("shares"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial with n trials of chance p: an exact sum, in logarithms so that no term is lost."""

    def add(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
        top, low = F.greatest(acc["sum"], term), F.least(acc["sum"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(low - top))).alias("sum"))

    start = n * F.log1p(F.lit(-p))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, F.struct(start.alias("term"), start.alias("sum")), add)["sum"])


def choose_cutoffs(measured: DataFrame, good: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, cutoffs): for each rule the largest share in thousandths that stays, 1000 where nothing can be shown.

    good has the doc_id of texts labelled good. Counts go over all of them; what is left is a histogram of at
    most 1000 / STEP + 1 rows a stratum and rule.
    """
    ids = good.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    labelled = measured.where("not base_failed").join(ids, "doc_id", "left_semi")
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"shares.{r}").alias("share")) for r in RULES)))
    bins = labelled.select("stratum", rules.alias("r")).groupBy("stratum", "r.rule",
        F.ceil(F.col("r.share") / STEP).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    # a row for each cutoff, also where no text has that share
    grid = bins.select("stratum", "rule").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(1000 // STEP))))
    bins = grid.join(bins, ["stratum", "rule", "bin"], "left").fillna(0, ["n"])
    group = Window.partitionBy("stratum", "rule")
    above = F.coalesce(F.sum("n").over(group.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tests = bins.withColumn("above", above).withColumn("all", F.sum("n").over(group))
    tests = tests.crossJoin(bins.select("stratum", "rule").distinct().agg(F.count("*").alias("tests")))  # one row
    rate = risk / len(RULES)
    tail = F.when(F.col("above") <= rate * F.col("all"), binomial_tail(F.col("above"), F.col("all"), rate)).otherwise(F.lit(1.0))
    passed = tests.where(tail <= delta / F.col("tests")).groupBy("stratum", "rule").agg((F.min("bin") * STEP).alias("cutoff"))
    return passed.groupBy("stratum").agg(*(F.coalesce(F.max(F.when(F.col("rule") == r, F.col("cutoff"))), F.lit(1000)).alias(f"max_{r}") for r in RULES))


def apply_rules(docs: DataFrame, good: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row of docs.

    docs has doc_id, text and lang (the stratum), good the doc_id of texts labelled good. kept is false where a
    base rule fails (under 50 words, or over half of them repeated) or a share is above its stratum's cutoff.

    A null or empty text has no words and fails. A null lang is a stratum of its own (und). A null doc_id has no
    label. Repeated rows count as often as they are there. Shares equal to a cutoff stay. Other columns are
    ignored. An empty table gives an empty result; without labels only the base rules reject.
    """
    measured = keep(measure(docs), "measured")
    cut = choose_cutoffs(measured, good, risk, delta)
    out = measured.join(cut, "stratum", "left")
    fine = F.lit(True)
    for r in RULES:
        fine = fine & (F.col(f"shares.{r}") <= F.coalesce(f"max_{r}", F.lit(1000)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fine).alias("kept"))
