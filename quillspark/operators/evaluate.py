"""How good an attribution is: accuracy, confusion, agreement, calibration, alignment, styles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .attribute import SPEECH_VERBS

NOT_SPEECH = ("GROUP", "NOT_SPEECH")
BUCKETS = (0.0, 0.4, 0.7, 0.95, 1.0)
_VERBS = "|".join(SPEECH_VERBS)
_NAME = r"\b[A-Z][a-zA-Z]+\b"


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def with_gold(predicted: DataFrame, gold: DataFrame, how: str = "left") -> DataFrame:
    """Predictions (quote_id, speaker, confidence) beside the gold speakers (`actual`, unknown if there is none)."""
    g = gold.select("quote_id", F.col("speaker").alias("actual"))
    return predicted.join(g, "quote_id", how).withColumn("actual", F.coalesce("actual", F.lit("unknown")))


def accuracy(scored: DataFrame) -> DataFrame:
    """One row: overall, and over speech only (without groups and what isn't speech)."""
    right = F.col("speaker") == F.col("actual")
    speech = ~F.col("actual").isin(*NOT_SPEECH)
    return scored.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(right).alias("correct"), F.count_if(speech).alias("speech_total"), F.count_if(right & speech).alias("speech_correct")
    ).select("total", "correct", ratio(F.col("correct"), F.col("total")).alias("overall_accuracy"), ratio(F.col("speech_correct"), F.col("speech_total")).alias("speech_only_accuracy"))


def accuracy_by_style(scored: DataFrame, styles: DataFrame) -> DataFrame:
    """Rows (style, total, correct, accuracy); quotes without a style are untagged."""
    joined = scored.join(styles.select("quote_id", "style"), "quote_id", "left").withColumn("style", F.coalesce("style", F.lit("untagged")))
    out = joined.groupBy("style").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("speaker") == F.col("actual")).alias("correct"))
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def confusion(scored: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent wrong pairs."""
    return scored.where("speaker <> actual").groupBy(F.col("speaker").alias("predicted"), "actual").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "predicted", "actual").limit(top)


def _prf(counts: DataFrame) -> DataFrame:
    """Counts tp, fp, fn in one row with precision, recall and F1."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def alias_prf(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Alias pairs (canonical, alias): counts and P, R, F1. One full join."""
    g = gold.select("canonical", "alias").distinct().withColumn("g", F.lit(True))
    p = predicted.select("canonical", "alias").distinct().withColumn("p", F.lit(True))
    both = g.join(p, ["canonical", "alias"], "full")
    return _prf(both.agg(F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")))


def alignment(gold: DataFrame, found: DataFrame, by_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """Quotes of the gold set and of the extractor: a row (quote_id, outcome) each, and the counts with P, R, F1.

    They meet by quote_id; with `by_text` the texts must agree too.
    """
    g = gold.select("quote_id", F.col("text").alias("gt"), F.lit(True).alias("g"))
    e = found.select("quote_id", F.col("text").alias("et"), F.lit(True).alias("e"))
    both = g.join(e, "quote_id", "full")
    same = (F.col("g") & F.col("e")) & (F.col("gt").eqNullSafe(F.col("et")) if by_text else F.lit(True))
    outcome = F.when(F.coalesce(same, F.lit(False)), "matched").when(F.col("g").isNotNull() & F.col("e").isNull(), "missed").when(F.col("g").isNull(), "invented").otherwise("differs")
    rows = both.select("quote_id", outcome.alias("outcome"))
    wrong = F.col("outcome") == "differs"
    return rows, _prf(rows.agg(F.count_if(F.col("outcome") == "matched").alias("tp"), F.count_if((F.col("outcome") == "invented") | wrong).alias("fp"), F.count_if((F.col("outcome") == "missed") | wrong).alias("fn")))


def kappa(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row (n, agreement, kappa) over the quotes both labelled. Chance agreement comes from the two marginals, summed by label."""
    both = one.select("quote_id", F.col("label").alias("a")).join(two.select("quote_id", F.col("label").alias("b")), "quote_id")
    cells = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.inline(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")), F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb")))))
    chance = sides.groupBy("label").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("products"))
    seen = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)), F.lit(0)).alias("same"))
    joined = seen.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("products") / (F.col("n").cast("double") * F.col("n"))
    return joined.select("n", ratio(F.col("same"), F.col("n")).alias("agreement"), F.when(F.col("n") == 0, 0.0).when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


#: Counts below this are drawn by the distribution's own steps, from it on by the normal approximation with its skew.
LARGE_COUNT = 32


def _poisson(mean: Column, a: Column, b: Column) -> Column:
    """A Poisson variable from two uniform ones."""
    z = F.sqrt(-2 * F.log(a)) * F.cos(F.lit(2 * math.pi) * b)
    large = F.greatest(F.lit(0.0), F.floor(mean + z * F.sqrt(mean) + (z * z - 1) / 6 + 0.5).cast("double"))
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("total"), F.lit(0.0).alias("k"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["total"] + p).alias("total"), (s["k"] + F.when(a >= s["total"], 1.0).otherwise(0.0)).alias("k"))

    return F.when(mean < LARGE_COUNT, F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, step, lambda s: s["k"])).otherwise(large)


def bootstrap(values: DataFrame, value: str, *keys: str, rounds: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """A row (keys, lower, upper) of the mean's interval, by resampling; without keys one row, 0 and 0 if there are no values.

    Of a value that is there n times a round has a Poisson number with mean n, drawn from
    a digest of the seed, the round, the keys and the value. So what is drawn are distinct values times rounds, not rows, and the
    result doesn't depend on how rows are dealt out. Rounds that draw nothing are left out.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    text = F.coalesce(F.col("v").try_cast("decimal(38,12)").cast("string"), F.col("v").cast("string"))
    drawn = counts.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    drawn = drawn.withColumn("h", F.sha2(F.concat_ws("|", F.lit(seed), "round", *(F.col(k).cast("string") for k in keys), text), 256))
    uniform = lambda at: (F.conv(F.substring("h", at, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    drawn = drawn.withColumns({"a": uniform(1), "b": uniform(14)}).withColumn("times", _poisson(F.col("n"), F.col("a"), F.col("b")))
    means = drawn.groupBy(*keys, "round").agg((F.sum(F.col("v") * F.col("times")) / F.nullif(F.sum("times"), F.lit(0.0))).alias("mean"))
    means = means.groupBy(*keys).agg(F.array_sort(F.collect_list("mean")).alias("m"))
    at = lambda q: F.coalesce(F.try_element_at("m", F.greatest(F.lit(1), F.least(F.size("m"), F.lit(int(q * rounds) + 1)))), F.lit(0.0))
    return means.select(*keys, at((1 - level) / 2).alias("lower"), at(1 - (1 - level) / 2).alias("upper"))


def calibration_buckets(scored: DataFrame, bounds: tuple[float, ...] = BUCKETS, closed: bool = False) -> DataFrame:
    """Rows (lo, hi, total, correct, accuracy) for every bucket [lo, hi), empty ones too; with `closed` the last holds its end.

    All buckets are counted in one aggregate, without a join.
    """
    right, c = F.col("speaker") == F.col("actual"), F.col("confidence")
    parts = []
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        inside = (c >= lo) & ((c <= hi) if closed and i == len(bounds) - 2 else (c < hi))
        parts.append(F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.count_if(inside).alias("total"), F.count_if(inside & right).alias("correct")))
    out = scored.agg(F.array(*parts).alias("b")).select(F.inline("b"))
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def calibration_curve(scored: DataFrame, n: int = 20) -> DataFrame:
    """Rows (threshold, precision, review_fraction) for n thresholds from 0 to 1.

    Precision is that of what is accepted, review what is below. One aggregate with two sums per threshold.
    """
    right, c = F.col("speaker") == F.col("actual"), F.col("confidence")
    parts = []
    for i in range(n):
        t = i / (n - 1)
        taken = c >= t
        parts.append(F.struct(F.lit(t).alias("threshold"), F.count_if(taken).alias("accepted"), F.count_if(taken & right).alias("correct"), F.count(F.lit(1)).alias("total")))
    out = scored.agg(F.array(*parts).alias("p")).select(F.inline("p"))
    return out.select("threshold", ratio(F.col("correct"), F.col("accepted")).alias("precision"), ratio(F.col("total") - F.col("accepted"), F.col("total")).alias("review_fraction"))


def propose_threshold(curve: DataFrame, precision: float = 0.95, review: float = 0.5) -> DataFrame:
    """One row (threshold, tier): the lowest threshold that is precise enough with little review, else precise enough, else the most precise."""
    good = F.col("precision") >= precision
    best = good & (F.col("review_fraction") <= review)
    row = curve.agg(
        F.min(F.when(best, F.col("threshold"))).alias("a"), F.min(F.when(good, F.col("threshold"))).alias("b"), F.min_by("threshold", F.struct(-F.col("precision"), F.col("threshold"))).alias("c")
    )
    return row.select(F.coalesce("a", "b", "c").alias("threshold"), F.when(F.col("a").isNotNull(), "both").when(F.col("b").isNotNull(), "precision").otherwise("best").alias("tier"))


def quote_style(before: Column, after: Column, speakers: Column) -> Column:
    """How a quote is tagged, by what stands around it and who speaks in the scene; the first that fits."""
    named = after.rlike(rf"(?iU)[,;:]\s+({_VERBS})\s+{_NAME}") | before.rlike(rf'(?iU){_NAME}\s+({_VERBS})[,;:]\s+"')
    pronoun = after.rlike(rf'(?iU)\b(he|she|they|it)\s+({_VERBS})[,;:]\s+"') | before.rlike(rf"(?iU)\b(he|she|they|it)\s+({_VERBS})[,;:]")
    return F.when(named, "tagged").when(pronoun, "pronoun_tagged").when(F.array_contains(speakers, "I"), "first_person").when(F.size(F.array_distinct(speakers)) >= 3, "three_or_more").otherwise("untagged")


def styles(quotes: DataFrame, contexts: DataFrame, speakers: DataFrame) -> DataFrame:
    """Rows (chapter, quote_id, style): contexts (paragraph_id, before, after) may lack, speakers (chapter, speaker) are those of the chapter."""
    scene = speakers.groupBy("chapter").agg(F.collect_set("speaker").alias("speakers"))
    joined = quotes.join(contexts, "paragraph_id", "left").join(scene, "chapter", "left")
    none = F.array().cast("array<string>")
    return joined.select("chapter", "quote_id", quote_style(F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.coalesce("speakers", none)).alias("style"))


def style_counts(found: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Rows (style, n); overrides (quote_id, style) move a quote, and a style that loses all stays with 0."""
    if overrides is None:
        return found.groupBy("style").agg(F.count(F.lit(1)).alias("n"))
    joined = found.join(overrides.select("quote_id", F.col("style").alias("new")), "quote_id", "left")
    moves = joined.select(F.inline(F.array(F.struct(F.col("style"), F.when(F.col("new").isNull(), 1).otherwise(0).alias("k")), F.struct(F.coalesce("new", "style").alias("style"), F.when(F.col("new").isNull(), 0).otherwise(1).alias("k")))))
    return moves.groupBy("style").agg(F.sum("k").alias("n"))


def mean_by(rows: DataFrame, *keys: str, value: str = "seconds") -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def latest_runs(runs: DataFrame, n: int | None = None) -> DataFrame:
    """Runs, newest first; with `n` so many of each variant."""
    if n is None:
        return runs.orderBy(F.desc("started_at"), "run_id")
    place = F.row_number().over(W.partitionBy("variant").orderBy(F.desc("started_at"), "run_id"))
    return runs.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


#: The compared set-ups: paragraphs of context, and which steps are on. V0 and V2 are equal.
VARIANTS: dict[str, dict[str, object]] = {
    name: {"context_size": 1, "few_shot": False, "rules": rules, "alternation": alternation, "two_pass": two_pass}
    for name, rules, alternation, two_pass in (("V0", True, False, False), ("V1", False, False, False), ("V2", True, False, False), ("V3", True, True, False), ("V4", True, True, True))
}
