"""Filters, grouped summaries and rankings of scored tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import clipped, cut, equal_width, half_even, label, spread_labels
from .quantiles import with_quantiles


def successes(df: DataFrame, flag: str = "is_success") -> DataFrame:
    return df.filter(F.col(flag) == 1)


def failures(df: DataFrame, flag: str = "is_success") -> DataFrame:
    return df.filter(F.col(flag) != 1)


def fake_simple(df: DataFrame, kappa: str = "kappa_actual", flag: str = "is_success") -> DataFrame:
    """Failures that look simple: complexity 1 without success."""
    return df.filter((F.col(kappa) == 1) & (F.col(flag) == 0))


def load_report(df: DataFrame, flag: str, rate: str, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg(flag).alias("success_rate"), F.avg(rate).alias("mean_pass_rate"), F.avg(actual).alias("mean_actual"), F.avg(predicted).alias("mean_predicted"))


def spread_report(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, exact median and maximum."""
    out = df.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return with_quantiles(out, df, [], value, {"median": 0.5}).select("n", "mean", "median", "max")


def regime_report(df: DataFrame, kappa: str, outcome: str, gamma: float) -> DataFrame:
    """Rows and mean outcome at or below and above a threshold, and their difference."""
    k = F.col(kappa).cast("double")
    low, high = k <= gamma, (k > gamma) & ~F.isnan(k)
    mean = lambda side: F.avg(F.when(side, F.col(outcome)))
    return df.agg(F.count_if(low).alias("n_low"), F.count_if(high).alias("n_high"), mean(low).alias("mean_low"), mean(high).alias("mean_high"), (mean(low) - mean(high)).alias("difference"))


def naive_view(df: DataFrame, kappa: str, outcome: str, low: float | None = None, high: float = 15) -> DataFrame:
    """Mean outcome by observed complexity, to ``high`` and from ``low`` if given."""
    k = F.col(kappa)
    return df.filter(k <= high if low is None else k.between(low, high)).groupBy(k.alias("kappa")).agg(F.avg(outcome).alias("mean_outcome"), F.count("*").alias("n"))


def corrected_view(df: DataFrame, predicted: str, outcome: str, clip: tuple[float, float] | None = None, high: float = 15) -> DataFrame:
    """Mean outcome by predicted complexity, rounded half to even, or rounded and clipped."""
    k = clipped(F.col(predicted), *clip) if clip else half_even(F.col(predicted))
    rows = df.withColumn("kappa", k)
    return (rows if clip else rows.filter(F.col("kappa") <= high)).groupBy("kappa").agg(F.avg(outcome).alias("mean_outcome"), F.count("*").alias("n"))


def phase_cells(df: DataFrame, kappa: str, entropy: str, outcome: str, k_bins: int, e_bins: int, labels: bool = False) -> DataFrame:
    """Mean outcome over complexity and entropy bins in long form, empty cells left out; highest
    complexity first when ordered by ``k_bin`` descending.  ``labels`` adds labels that do not follow the data."""
    rows = equal_width(equal_width(df, kappa, k_bins, "k_bin"), entropy, e_bins, "e_bin")
    out = rows.filter("k_bin is not null and e_bin is not null").groupBy("k_bin", "e_bin").agg(F.avg(outcome).alias("mean_outcome"))
    if labels:
        out = out.withColumn("k_label", label(F.col("k_bin"), spread_labels(2, 16, k_bins, 0))).withColumn("e_label", label(F.col("e_bin"), spread_labels(0.1, 0.9, e_bins, 2)))
    return out


def phase_pivot(df: DataFrame, kappa: str, entropy: str, outcome: str, k_bins: int = 15, e_bins: int = 15) -> DataFrame:
    cells = phase_cells(df, kappa, entropy, outcome, k_bins, e_bins)
    return cells.groupBy("k_bin").pivot("e_bin", list(range(1, e_bins + 1))).agg(F.first("mean_outcome")).orderBy(F.desc("k_bin"))


def binned_trend(df: DataFrame, x: str, y: str, bins: int = 40) -> DataFrame:
    """Mean x and y, count, standard error of y and its 95% band per bin; bins of one row drop out."""
    rows = equal_width(df, x, bins, "bin").filter("bin is not null")
    out = rows.groupBy("bin").agg(F.avg(x).alias("mean_kappa"), F.avg(y).alias("mean_pass"), F.count(y).alias("count"), (F.stddev_samp(y) / F.sqrt(F.count(y))).alias("se"))
    out = out.filter("count >= 2 and mean_kappa is not null")
    return out.withColumn("low", F.col("mean_pass") - 1.96 * F.col("se")).withColumn("high", F.col("mean_pass") + 1.96 * F.col("se"))


PRED_EDGES = [0.0, 3.0, 6.5, 10.0, 15.0, 50.0]
OBS_EDGES = [0.0, 1.0, 3.0, 6.5, 10.0, 50.0]


def flow(df: DataFrame, predicted: str, observed: str, above: int = 50) -> DataFrame:
    """Rows from predicted to observed bins, more than ``above`` of them, and whether the flow shows a hidden complexity."""
    rows = df.select(cut(F.col(predicted), PRED_EDGES).alias("pred_bin"), cut(F.col(observed), OBS_EDGES).alias("obs_bin")).filter("pred_bin is not null and obs_bin is not null")
    out = rows.groupBy("pred_bin", "obs_bin").agg(F.count("*").alias("count")).filter(F.col("count") > above)
    return out.withColumn("wrong", ((F.col("obs_bin") == 1) & (F.col("pred_bin") != 1)).cast("int"))


def flow_labels(flows: DataFrame, column: str) -> DataFrame:
    """The distinct bins of one side in their order."""
    return flows.select(column).distinct().orderBy(column)


def violin(df: DataFrame, kappa: str, value: str, low: float = 1, high: float = 8) -> DataFrame:
    """Distribution of a value per observed complexity."""
    rows = df.filter(F.col(kappa).between(low, high)).select(F.col(kappa).alias("kappa"), F.col(value).alias("value"))
    out = rows.groupBy("kappa").agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))
    return with_quantiles(out, rows, ["kappa"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}).select("kappa", "n", "min", "q1", "median", "q3", "max", "mean")


def draw_report(draws: DataFrame, value: str) -> DataFrame:
    """Mean, population deviation, median and the 5th and 95th percentile of resampling draws."""
    out = draws.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return with_quantiles(out, draws, [], value, {"median": 0.5, "p05": 0.05, "p95": 0.95})


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("corr"))


def r_squared(y: str, p: str) -> Column:
    """Share of variance explained, from sums only."""
    return 1 - F.sum(F.pow(F.col(y) - F.col(p), 2)) / (F.var_pop(y) * F.count(y))


def fold_scores(oof: DataFrame, y: str, p: str, fold: str = "fold") -> DataFrame:
    return oof.groupBy(fold).agg(r_squared(y, p).alias("r2"), F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"))


def cv_report(oof: DataFrame, y: str, p: str, fold: str = "fold") -> DataFrame:
    """Mean, population deviation and range of the folds' R-squared, mean absolute error, and R-squared over all rows."""
    folds = fold_scores(oof, y, p, fold).agg(F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("sd_r2"), F.min("r2").alias("min_r2"), F.max("r2").alias("max_r2"), F.avg("mae").alias("mean_mae"))
    return folds.crossJoin(oof.agg(r_squared(y, p).alias("oof_r2")))  # one row each


def top(df: DataFrame, value: str, key: str) -> DataFrame:
    """The row with the largest value; of equal ones that with the smallest key."""
    return df.orderBy(F.desc(value), F.asc(key)).limit(1)


