"""Paired significance of two systems on the same items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as X

# Fixed value: the note on results of fewer than two pairs.
TOO_FEW = "Insufficient paired items (need n >= 2)."


def yes_no_score(prediction: Column, label: Column) -> Column:
    """1 or 0; null, and so not scored, unless both are yes or no."""
    fine = prediction.isin("yes", "no") & F.lower(label).isin("yes", "no")
    return F.when(fine, (prediction == F.lower(label)).cast("double"))


def option_score(correct: Column, prediction: Column, answer: Column) -> Column:
    """The logged verdict, else equality of the letters."""
    a = F.upper(X.strip(answer))
    return F.when(correct.isNotNull(), correct.cast("double")).when((a != "") & prediction.isNotNull(), (F.upper(X.strip(prediction)) == a).cast("double"))


def scores_by_key(rows: DataFrame, key: Column, score: Column, order: str) -> DataFrame:
    """(key, score): unscored rows go, of repeated keys the last counts, of those that tie the greater score."""
    return rows.select(key.cast("string").alias("key"), score.alias("score"), F.col(order).alias("_o")).where("score is not null").groupBy("key").agg(F.max_by("score", F.struct("_o", "score")).alias("score"))


def merge_paired(baseline: DataFrame, final: DataFrame) -> DataFrame:
    return baseline.select("key", F.col("score").alias("b")).join(final.select("key", F.col("score").alias("f")), "key").withColumn("d", F.col("f") - F.col("b"))


def paired_moments(pairs: DataFrame, by: list[str]) -> DataFrame:
    """One aggregate: n, accuracies, mean difference, its standard error, and McNemar's cells."""
    cell = lambda x, y: F.count_if(x & y)
    b, f = F.col("b") != 0, F.col("f") != 0
    n = F.count(F.lit(1))
    return pairs.groupBy(*by).agg(
        n.alias("n"), (100 * F.avg("b")).alias("baseline_acc_pct"), (100 * F.avg("f")).alias("final_acc_pct"), F.avg("d").alias("mean_delta"), (F.stddev_samp("d") / F.sqrt(n.cast("double"))).alias("sem"),
        cell(b, f).alias("both_ok"), cell(b, ~f).alias("ok_fail"), cell(~b, f).alias("fail_ok"), cell(~b, ~f).alias("both_fail"),
    )


def paired_result(pairs: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """t-test on the differences and McNemar's test; fewer than two pairs give NaN and a note."""
    m = paired_moments(pairs, by)
    enough, nan = F.col("n") >= 2, F.lit(S.NAN)
    df = (F.col("n") - 1).cast("double")
    t = F.when(~enough, nan).otherwise(F.col("mean_delta") / F.nullif(F.col("sem"), F.lit(0.0)))
    t = F.when(enough & (F.col("sem") == 0), F.when(F.col("mean_delta") == 0, nan).otherwise(F.signum("mean_delta") * F.lit(float("inf")))).otherwise(t)
    half = S.t_critical(1 - alpha / 2, df) * F.col("sem")
    low, high = S.mcnemar_interval(F.col("ok_fail"), F.col("fail_ok"), F.col("n"), alpha)
    p, mp = S.t_p_value(F.col("t_stat"), df), S.mcnemar_p(F.col("ok_fail"), F.col("fail_ok"))
    m = m.withColumn("t_stat", t).withColumn("p_value", p).withColumn("mcnemar_p", F.when(enough, mp).otherwise(nan))
    sure = lambda c: (F.col(c) < alpha) & ~F.isnan(c)
    return m.select(
        *by, "n", "baseline_acc_pct", "final_acc_pct", (100 * F.col("mean_delta")).alias("delta_pp"),
        F.when(enough, 100 * (F.col("mean_delta") - half)).otherwise(nan).alias("ci_low_pp"), F.when(enough, 100 * (F.col("mean_delta") + half)).otherwise(nan).alias("ci_high_pp"),
        "t_stat", F.greatest(F.lit(0), F.col("n") - 1).alias("df"), "p_value", sure("p_value").alias("significant"),
        F.when(enough, S.mcnemar_chi2(F.col("ok_fail"), F.col("fail_ok"))).otherwise(nan).alias("mcnemar_chi2"), "mcnemar_p", sure("mcnemar_p").alias("mcnemar_significant"),
        F.when(enough, low).otherwise(nan).alias("mcnemar_ci_low_pp"), F.when(enough, high).otherwise(nan).alias("mcnemar_ci_high_pp"),
        ((F.col("ok_fail") + F.col("fail_ok") < S.EXACT_BELOW) & (F.col("ok_fail") + F.col("fail_ok") > 0)).alias("mcnemar_exact"), "both_ok", "ok_fail", "fail_ok", "both_fail",
        F.when(~enough, F.lit(TOO_FEW)).otherwise(F.lit("")).alias("notes"),
    )


def ablation_deltas(results: DataFrame, benchmark: str, baseline: str, final: str) -> DataFrame:
    """Per benchmark the difference, and (benchmark null) its mean."""
    rows = results.select(benchmark, baseline, final, (F.col(final) - F.col(baseline)).alias("delta_pp"))
    return rows.unionByName(rows.agg(F.avg("delta_pp").alias("delta_pp")).select(F.lit(None).cast("string").alias(benchmark), F.lit(None).cast("double").alias(baseline), F.lit(None).cast("double").alias(final), "delta_pp"))
