"""Quality rules with risk-controlled thresholds (DataFrame operations only).

Each rule rejects a document whose feature reaches a cutoff. For every stratum (the
language) cutoffs are chosen on the labelled rows: going from the mildest cutoff of a
fixed grid to the strictest, a cutoff is admissible as long as the exact binomial
probability of seeing so few rejected good documents, were the true rejection rate
``risk / rules``, is at most ``delta / (strata * rules)``. Testing in that fixed order
needs no further correction within a grid (the first failure ends it); the division
by strata and rules is Bonferroni's. So with probability 1 - delta no stratum loses
more than ``risk`` of its good documents to the rules together. Among the admissible
cutoffs the one with the greatest gain (bad minus ``good_cost`` times good documents
rejected, the mildest on ties) is used; a stratum without a gainful one rejects none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.llm.common import BLANK_RUN, BLANKS, let, materialise

#: rule name -> (SQL over the features, cutoffs from strict to mild)
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]),
    "dup_lines": ("n_dup_lines / n_lines", [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9]),
    "repeats": ("n_repeat_words / n_words", [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.75, 0.9]),
    "capitals": ("n_upper / word_chars", [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 0.9]),
    "long_words": ("word_chars / n_words", [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 14.0, 18.0, 25.0, 50.0]),
    "short_words": ("-word_chars / n_words", [-4.0, -3.5, -3.0, -2.5, -2.0, -1.5, -1.0]),
}
#: Strata whose thresholds are broadcast at most; more are joined without it.
MAX_STRATA = 1024


def repeated_words(w: Column) -> Column:
    """Words of the array ``w`` inside 3-word windows that occur at least twice in it (first occurrences included)."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2]))

    def covered(p: Column) -> Column:
        widths = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(widths, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        same = lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])
        marked = F.transform(s, lambda x, k: F.when(same(x, k), x["i"]))
        return let(F.sort_array(F.filter(marked, lambda x: x.isNotNull())), covered)

    def count(g: Column) -> Column:
        tagged = F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(let(F.sort_array(tagged), twice))

    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) < 4, F.lit(0).cast("bigint")).otherwise(let(let(hashed, windows), count))


def features(docs: DataFrame, keep: list | None = None) -> DataFrame:
    """Columns ``keep`` (names or Columns; doc_id and lang by default) and the counts of the rules, from whole texts; null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.greatest(F.size(lines), F.lit(1)).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        )

    trimmed = F.btrim(text, F.lit(BLANKS))
    w = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN, -1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    keep = keep or ["doc_id", "lang"]
    counted = docs.select(
        *keep,
        let(w, of_words).alias("__w"),
        let(lines, of_lines).alias("__l"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint").alias("n_upper"),
    )
    return counted.select(*counted.columns[: len(keep)], "__w.*", "__l.*", "n_symbols", "n_upper")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), summed term by term in logarithms."""
    odds = F.log(F.lit(p / (1 - p)))

    def step(a: Column, i: Column) -> Column:
        term = a["t"] + F.log((n - i) / (i + 1)) + odds
        return F.struct(term.alias("t"), (F.greatest(a["s"], term) + F.log1p(F.exp(-F.abs(a["s"] - term)))).alias("s"))

    first = n * F.log1p(F.lit(-p))
    i = F.when(k > 0, F.sequence(F.lit(0).cast("bigint"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(i, F.struct(first.alias("t"), first.alias("s")), step)["s"]


def thresholds(labelled: DataFrame, risk: float = 0.05, delta: float = 0.05, good_cost: float = 20.0) -> DataFrame:
    """One row a stratum: stratum, cuts map<rule, cutoff>. ``labelled``: stratum, quality (1 good, 0 bad) and the features."""
    rules = F.array(
        *(
            F.struct(
                F.lit(name).alias("rule"),
                F.array(*map(F.lit, grid)).alias("grid"),
                F.coalesce(F.expr(value).cast("double"), F.lit(float("-inf"))).alias("value"),
            )
            for name, (value, grid) in RULES.items()
        )
    )
    counts = (
        labelled.filter("n_words > 0 AND quality IN (0, 1)")
        .select("stratum", "quality", F.explode(rules).alias("r"))
        .select("stratum", "quality", "r.rule", "r.grid", F.size(F.filter("r.grid", lambda c: F.col("r.value") >= c)).alias("level"))
        .groupBy("stratum", "rule", "level")
        .agg(F.first("grid").alias("grid"), F.sum("quality").cast("bigint").alias("good"), F.sum(1 - F.col("quality")).cast("bigint").alias("bad"))
    )
    # One row a stratum and rule, then one a cutoff: level j rejects the rows with level >= j.
    per_rule = counts.groupBy("stratum", "rule").agg(
        F.first("grid").alias("grid"), F.sum("good").alias("n_good"), F.collect_list(F.struct("level", "good", "bad")).alias("levels")
    )
    n_strata = max(1, per_rule.select("stratum").distinct().count())
    rejected = lambda part: F.aggregate(
        F.filter("levels", lambda x: x["level"] > F.col("j")), F.lit(0).cast("bigint"), lambda a, x: a + x[part]
    )
    tested = (
        per_rule.select("*", F.posexplode("grid").alias("j", "cutoff"))
        .select("stratum", "rule", "n_good", "j", "cutoff", rejected("good").alias("good"), rejected("bad").alias("bad"))
    )
    rate = risk / len(RULES)
    passes = (F.col("good") <= F.col("n_good") * rate) & (
        log_binomial_cdf(F.col("good"), F.col("n_good"), rate) <= math.log(delta / len(RULES) / n_strata)
    )
    milder = W.partitionBy("stratum", "rule").orderBy(F.desc("j"))
    gain = F.col("bad") - good_cost * F.col("good")
    best = (
        tested.withColumn("ok", F.min(F.when(passes, 1).otherwise(0)).over(milder))
        .filter((F.col("ok") == 1) & (gain > 0))
        .groupBy("stratum", "rule")
        .agg(F.max(F.struct(gain.alias("gain"), F.col("j"), F.col("cutoff"))).alias("best"))
    )
    return (
        best.groupBy("stratum")
        .agg(F.map_from_entries(F.collect_list(F.struct("rule", F.col("best.cutoff").alias("cutoff")))).alias("cuts"))
    )


def with_cuts(counted: DataFrame, cuts: DataFrame) -> DataFrame:
    """``counted`` with the cuts of its stratum; more than MAX_STRATA of them are not sent to every executor."""
    cuts = materialise(cuts, "quality-cuts")
    few = cuts.limit(MAX_STRATA + 1).count() <= MAX_STRATA
    return counted.join(F.broadcast(cuts) if few else cuts, "stratum", "left")


def rejecting() -> Column:
    """Names of the rules that reject a row with the features and ``cuts``."""
    return F.array_compact(
        F.array(*(F.when(F.coalesce(F.expr(value).cast("double") >= F.col("cuts")[name], F.lit(False)), F.lit(name)) for name, (value, _) in RULES.items()))
    )


def quality_rules(docs: DataFrame, labels: DataFrame, **risk: float) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang) with the counts, base_failed, failed_rules and kept.

    ``labels`` (doc_id, quality) gives the holdout; null ids and labels are left out of it,
    and of several labels of one id the smallest counts. Null text counts as empty (and
    fails the base rule), a null lang is a stratum of its own, empty tables give no
    rows, and without labels no rule but the base rule rejects. Other columns are ignored.
    """
    counted = materialise(features(docs), "quality").withColumn("stratum", F.coalesce("lang", F.lit("\x00none")))
    held = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    cuts = thresholds(counted.join(held, "doc_id").filter(~base_failed()), **risk)
    return (
        with_cuts(counted, cuts)
        .withColumn("base_failed", base_failed())
        .withColumn("failed_rules", F.when(F.col("n_words") > 0, rejecting()).otherwise(F.array().cast("array<string>")))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules",
        )
    )


def keep_good(docs: DataFrame, labels: DataFrame, **risk: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, that quality_rules keeps (see there for the cases).

    Texts are counted once; the counts are written without them, thresholds and verdicts read
    these alone, and a semi-join brings the rows that stay. Rows equal in id, text and lang share a verdict.
    """
    ref = {"__id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))), "__hash": F.xxhash64(F.coalesce("text", F.lit("")), "doc_id", "lang")}
    stratum = F.coalesce("lang", F.lit("\x00none")).alias("stratum")
    counted = materialise(features(docs, [*(c.alias(n) for n, c in ref.items()), "doc_id", stratum]), "quality")
    held = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    cuts = thresholds(counted.join(held, "doc_id").filter(~base_failed()), **risk)
    kept = with_cuts(counted, cuts).filter(~base_failed() & (F.size(rejecting()) == 0)).select("__id", "__hash")
    return docs.withColumns(ref).join(materialise(kept, "kept"), ["__id", "__hash"], "left_semi").drop("__id", "__hash")
