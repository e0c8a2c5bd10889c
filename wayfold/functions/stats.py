"""Descriptive statistics, correlation, entropy and circular statistics as aggregate Columns.

All are combinations of built-in aggregates, for groupBy().agg() or over a window. Too little data or no spread gives 0
where a number is promised, as the docstrings say; nulls are skipped.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import col
from wayfold.plans.ranking import with_ranks


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def mean(x) -> Column:
    return zero(F.avg(col(x)))


def weighted_mean(x, w) -> Column:
    return zero(F.try_divide(F.sum(col(x) * col(w)), F.sum(col(w))))


def variance(x) -> Column:
    """Sample variance, 0 for fewer than two values."""
    return zero(F.var_samp(col(x)))


def weighted_variance(x, w) -> Column:
    m = F.try_divide(F.sum(col(x) * col(w)), F.sum(col(w)))
    return zero(F.greatest(F.try_divide(F.sum(col(w) * col(x) * col(x)), F.sum(col(w))) - m * m, F.lit(0.0)))


def stddev(x) -> Column:
    return zero(F.stddev_samp(col(x)))


def weighted_stddev(x, w) -> Column:
    return F.sqrt(weighted_variance(x, w))


def quantile(x, q: float) -> Column:
    """Linear interpolation between order statistics."""
    return F.percentile(col(x), q)


def median(x) -> Column:
    return quantile(x, 0.5)


def value_range(x) -> Column:
    return zero(F.max(col(x)) - F.min(col(x)))


def mode(x) -> Column:
    """Most frequent value, the least one on ties."""
    return F.mode(col(x), True)


def coefficient_of_variation(x) -> Column:
    return zero(F.try_divide(F.stddev_samp(col(x)), F.avg(col(x))))


def skewness(x) -> Column:
    """Adjusted sample skewness, 0 for fewer than three values or no spread."""
    n = F.count(col(x))
    spread = F.coalesce(F.var_pop(col(x)), F.lit(0.0)) > 0
    return F.when((n > 2) & spread, F.skewness(col(x)) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)


def kurtosis(x) -> Column:
    """Adjusted sample excess kurtosis, 0 for fewer than four values or no spread."""
    n = F.count(col(x))
    spread = F.coalesce(F.var_pop(col(x)), F.lit(0.0)) > 0
    return F.when((n > 3) & spread, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col(x)) + 6)).otherwise(0.0)


def iqr(x) -> Column:
    return quantile(x, 0.75) - quantile(x, 0.25)


def percentiles(x, shares: list[float]) -> Column:
    return F.percentile(col(x), F.array(*map(F.lit, shares)))


def five_numbers(x) -> Column:
    return percentiles(x, [0.0, 0.25, 0.5, 0.75, 1.0])


def deciles(x) -> Column:
    return percentiles(x, [k / 10 for k in range(1, 10)])


def percentile_rank(x, value: float) -> Column:
    """Percent of values that are at most `value`."""
    return 100 * zero(F.avg((col(x) <= value).cast("double")))


def outlier_bounds(x) -> Column:
    low, high = quantile(x, 0.25), quantile(x, 0.75)
    return F.struct((low - 1.5 * (high - low)).alias("low"), (high + 1.5 * (high - low)).alias("high"))


def _whole(partition: list[str]):
    return Window.partitionBy(*(F.col(c) for c in partition)) if partition else Window.partitionBy(F.lit(0))


def with_zscore(df: DataFrame, x: str, partition: list[str], name: str = "z") -> DataFrame:
    w = _whole(partition)
    return df.withColumn(name, zero(F.try_divide(F.col(x) - F.avg(x).over(w), F.stddev_samp(x).over(w))))


def _joined(df: DataFrame, aggregates: list[Column], partition: list[str]) -> DataFrame:
    """df with group aggregates beside each row: two stages with a small table between, not one window per group."""
    if not partition:
        return df.crossJoin(F.broadcast(df.agg(*aggregates)))  # one row
    return df.join(df.groupBy(*partition).agg(*aggregates), partition)


def normalised(df: DataFrame, x: str, partition: list[str], name: str = "scaled") -> DataFrame:
    """Min-max scaling to 0..1; 1 where all values are equal."""
    both = _joined(df, [F.min(x).alias("_low"), F.max(x).alias("_high")], partition)
    scaled = F.when(F.col("_high") > F.col("_low"), F.try_divide(F.col(x) - F.col("_low"), F.col("_high") - F.col("_low"))).otherwise(1.0)
    return both.withColumn(name, scaled).drop("_low", "_high")


def winsorized(df: DataFrame, x: str, low: float, high: float, partition: list[str], name: str = "winsorized") -> DataFrame:
    both = _joined(df, [quantile(x, low).alias("_low"), quantile(x, high).alias("_high")], partition)
    return both.withColumn(name, F.greatest(F.least(F.col(x), F.col("_high")), F.col("_low"))).drop("_low", "_high")


def trimmed(df: DataFrame, x: str, low: float, high: float, partition: list[str]) -> DataFrame:
    both = _joined(df, [quantile(x, low).alias("_low"), quantile(x, high).alias("_high")], partition)
    return both.where(F.col(x).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def with_outlier_flag(df: DataFrame, x: str, partition: list[str], name: str = "is_outlier") -> DataFrame:
    """Outside 1.5 interquartile ranges."""
    both = _joined(df, [outlier_bounds(x).alias("_bounds")], partition)
    return both.withColumn(name, (F.col(x) < F.col("_bounds.low")) | (F.col(x) > F.col("_bounds.high"))).drop("_bounds")


def with_mad_flag(df: DataFrame, x: str, threshold: float, partition: list[str], name: str = "is_outlier") -> DataFrame:
    """Modified z-score by the median absolute deviation; never flagged where that is 0."""
    centred = _joined(df, [median(x).alias("_median")], partition).withColumn("_off", F.abs(F.col(x) - F.col("_median")))
    both = _joined(centred, [median("_off").alias("_mad")], partition)
    return both.withColumn(name, zero(F.try_divide(0.6745 * F.col("_off"), F.col("_mad"))) > threshold).drop("_median", "_off", "_mad")


def correlation(x, y) -> Column:
    """Pearson, 0 without spread."""
    spread = (F.coalesce(F.var_pop(col(x)), F.lit(0.0)) > 0) & (F.coalesce(F.var_pop(col(y)), F.lit(0.0)) > 0)
    both = F.try_divide(F.covar_pop(col(x), col(y)), F.stddev_pop(col(x)) * F.stddev_pop(col(y)))
    return F.when(spread, both).otherwise(0.0)


def covariance(x, y) -> Column:
    return zero(F.covar_samp(col(x), col(y)))


def r_squared(x, y) -> Column:
    return F.pow(correlation(x, y), 2)


def regression(x, y) -> Column:
    """struct<slope, intercept> of y on x; slope 0 without spread of x."""
    slope = zero(F.try_divide(F.covar_pop(col(x), col(y)), F.var_pop(col(x))))
    return F.struct(slope.alias("slope"), (F.avg(col(y)) - slope * F.avg(col(x))).alias("intercept"))


def rmse(actual, predicted) -> Column:
    return F.sqrt(F.avg(F.pow(col(actual) - col(predicted), 2)))


def mae(actual, predicted) -> Column:
    return F.avg(F.abs(col(actual) - col(predicted)))


def with_average_rank(df: DataFrame, x: str, partition: list[str], name: str) -> DataFrame:
    """The mean rank of equal values, from 1; large groups spread over tasks (plans/ranking.py)."""
    return with_ranks(df, x, partition).withColumn(name, F.col("_below") + (F.col("_ties") + 1) / 2).drop("_below", "_ties", "_total")


def spearman(df: DataFrame, x: str, y: str, partition: list[str]) -> DataFrame:
    ranked = with_average_rank(with_average_rank(df, x, partition, "_rx"), y, partition, "_ry")
    return ranked.groupBy(*partition).agg(correlation("_rx", "_ry").alias("spearman"))


def partial_correlation(x, y, z) -> Column:
    a, b, c = correlation(x, y), correlation(x, z), correlation(y, z)
    return zero(F.try_divide(a - b * c, F.sqrt((1 - b * b) * (1 - c * c))))


def lagged_correlation(df: DataFrame, x: str, y: str, order: list[str], partition: list[str], max_lag: int) -> DataFrame:
    """Correlation of x with y moved by 0..max_lag rows: partition, lag, r."""
    w = _whole(partition).orderBy(*order)
    leads = df.select(*partition, F.col(x).alias("_x"), *(F.lead(y, k).over(w).alias(f"_y{k}") for k in range(max_lag + 1)))
    listed = F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_y{k}").alias("_y")) for k in range(max_lag + 1)))
    lags = leads.select(*partition, "_x", F.explode(listed).alias("_l")).select(*partition, "_x", "_l.*").where("_y is not null")
    return lags.groupBy(*partition, "lag").agg(correlation("_x", "_y").alias("r"))


def bins(x, low, high, n: int) -> Column:
    """Equal bins 0..n-1 over [low, high]; 0 without spread."""
    share = F.try_divide((col(x) - col(low)) * n, col(high) - col(low))
    return F.coalesce(F.least(F.floor(share).cast("int"), F.lit(n - 1)), F.lit(0))


def entropy(weight, base: float = 2.0) -> Column:
    """Entropy of the shares of positive weights in a group, without a second pass: ln W - sum(w ln w) / W."""
    w = F.when(col(weight) > 0, col(weight).cast("double"))
    nats = F.log(F.sum(w)) - F.try_divide(F.sum(w * F.log(w)), F.sum(w))
    return F.greatest(zero(nats / math.log(base)), F.lit(0.0))


def normalised_entropy(weight) -> Column:
    n = F.count(F.when(col(weight) > 0, 1))
    return F.when(n > 1, entropy(weight) / F.log2(n.cast("double"))).otherwise(0.0)


def gini_impurity(weight) -> Column:
    w = F.when(col(weight) > 0, col(weight).cast("double"))
    return zero(1 - F.try_divide(F.sum(w * w), F.pow(F.sum(w), 2)))


def divergences(df: DataFrame, p: str, q: str, partition: list[str]) -> DataFrame:
    """Cross entropy, Kullback-Leibler and Jensen-Shannon of two distributions given as weights on the same rows.

    Weights are made shares first. A row with p > 0 and q = 0 makes cross entropy and Kullback-Leibler infinite.
    """
    both = _joined(df, [F.sum(p).alias("_p"), F.sum(q).alias("_q")], partition)
    shares = both.withColumn("_p", zero(F.try_divide(F.col(p), F.col("_p")))).withColumn("_q", zero(F.try_divide(F.col(q), F.col("_q"))))
    a, b = F.col("_p"), F.col("_q")
    m = (a + b) / 2

    def part(x: Column, over: Column) -> Column:
        return F.when(x > 0, x * F.log2(F.try_divide(x, over))).otherwise(0.0)

    infinite = F.max(((a > 0) & (b == 0)).cast("int")) == 1
    cross = F.sum(F.when((a > 0) & (b > 0), -a * F.log2(b)).otherwise(0.0))
    kl = F.sum(F.when((a > 0) & (b > 0), part(a, b)).otherwise(0.0))
    return shares.groupBy(*partition).agg(
        F.when(infinite, float("inf")).otherwise(cross).alias("cross_entropy"), F.when(infinite, float("inf")).otherwise(kl).alias("kl_divergence"), F.sum((part(a, m) + part(b, m)) / 2).alias("js_divergence")
    )


def information(df: DataFrame, x: str, y: str, n: int, partition: list[str]) -> DataFrame:
    """Entropies of two binned columns: h_x, h_y, h_xy, mutual_information, conditional_entropy (of y given x)."""
    edges = [f(c).alias(f"_{f.__name__}_{c}") for c in (x, y) for f in (F.min, F.max)]
    binned = _joined(df, edges, partition)
    binned = binned.withColumn("_bx", bins(x, f"_min_{x}", f"_max_{x}", n)).withColumn("_by", bins(y, f"_min_{y}", f"_max_{y}", n))
    joint = binned.groupBy(*partition, "_bx", "_by").agg(F.count("*").alias("_n"))
    sides = [joint.groupBy(*partition, b).agg(F.sum("_n").alias("_n")).groupBy(*partition).agg(entropy("_n").alias(h)) for b, h in (("_bx", "h_x"), ("_by", "h_y"))]
    out = joint.groupBy(*partition).agg(entropy("_n").alias("h_xy"))
    for side in sides:
        out = out.join(side, partition) if partition else out.crossJoin(F.broadcast(side))
    return out.withColumn("mutual_information", F.col("h_x") + F.col("h_y") - F.col("h_xy")).withColumn("conditional_entropy", F.col("h_xy") - F.col("h_x"))


def resultant(angle_deg, weight=1.0) -> Column:
    """Mean resultant length of directions, 0 to 1."""
    a, w = F.radians(col(angle_deg)), col(weight)
    return zero(F.try_divide(F.sqrt(F.pow(F.sum(w * F.sin(a)), 2) + F.pow(F.sum(w * F.cos(a)), 2)), F.sum(w)))


def circular_mean(angle_deg, weight=1.0) -> Column:
    a, w = F.radians(col(angle_deg)), col(weight)
    return F.pmod(F.degrees(F.atan2(F.sum(w * F.sin(a)), F.sum(w * F.cos(a)))) + 360.0, F.lit(360.0))


def circular_variance(angle_deg, weight=1.0) -> Column:
    return 1 - resultant(angle_deg, weight)


def circular_stddev(angle_deg, weight=1.0) -> Column:
    return F.sqrt(-2 * F.log(F.greatest(resultant(angle_deg, weight), F.lit(1e-300))))


def circular_concentration(angle_deg, weight=1.0) -> Column:
    """Von Mises kappa by the usual three-part approximation."""
    r = resultant(angle_deg, weight)
    low = 2 * r + F.pow(r, 3) + 5 * F.pow(r, 5) / 6
    middle = -0.4 + 1.39 * r + 0.43 * F.try_divide(F.lit(1.0), 1 - r)
    high = F.try_divide(F.lit(1.0), F.pow(r, 3) - 4 * F.pow(r, 2) + 3 * r)
    return F.when(r < 0.53, low).when(r < 0.85, middle).otherwise(high)


def is_circular_uniform(angle_deg) -> Column:
    """Rayleigh test at 5 %."""
    return F.exp(-F.count(col(angle_deg)) * F.pow(resultant(angle_deg), 2)) > 0.05


def with_zscore_flag(df: DataFrame, x: str, threshold: float, partition: list[str], name: str = "is_outlier") -> DataFrame:
    """More than `threshold` standard deviations from the group's mean; never without spread."""
    both = _joined(df, [F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_sd")], partition)
    return both.withColumn(name, F.abs(zero(F.try_divide(F.col(x) - F.col("_mean"), F.col("_sd")))) > threshold).drop("_mean", "_sd")


def without_outliers(df: DataFrame, x: str, partition: list[str]) -> DataFrame:
    """The rows within 1.5 interquartile ranges."""
    return with_outlier_flag(df, x, partition, "_out").where(~F.col("_out")).drop("_out")


def predict(x, slope, intercept) -> Column:
    return col(intercept) + col(slope) * col(x)


def entropy_of_values(df: DataFrame, x: str, n: int, partition: list[str]) -> DataFrame:
    """partition, entropy of x in n equal bins over each group's range."""
    binned = _joined(df, [F.min(x).alias("_low"), F.max(x).alias("_high")], partition).withColumn("_bin", bins(x, "_low", "_high", n))
    return binned.groupBy(*partition, "_bin").agg(F.count("*").alias("_n")).groupBy(*partition).agg(entropy("_n").alias("entropy"))


def circular_mean_radians(angle, weight=1.0) -> Column:
    a, w = col(angle), col(weight)
    return F.pmod(F.atan2(F.sum(w * F.sin(a)), F.sum(w * F.cos(a))) + 2 * math.pi, F.lit(2 * math.pi))


def percentile_interval(df: DataFrame, x: str, share: float, confidence: float, partition: list[str]) -> DataFrame:
    """A confidence interval (lower, upper) of a quantile by the binomial ranks around its place, both values of x.

    No samples are drawn: equal values are counted once and ranks follow from the counts. Groups of fewer than two values
    give 0 and 0; nulls do not count.
    """
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    counts = df.where(F.col(x).isNotNull()).groupBy(*partition, F.col(x).alias("_x")).agg(F.count("*").alias("_c"))
    w = _whole(partition)
    ranked = counts.withColumn("_upto", F.sum("_c").over(w.orderBy("_x"))).withColumn("_n", F.sum("_c").over(w))
    n, spread = F.col("_n"), z * F.sqrt(F.col("_n") * share * (1 - share))
    low, high = F.greatest(F.lit(1), F.floor(n * share - spread)), F.least(n, F.ceil(n * share + spread) + 1)
    ends = ranked.groupBy(*partition).agg(F.min(F.when(F.col("_upto") >= low, F.col("_x"))).alias("lower"), F.min(F.when(F.col("_upto") >= high, F.col("_x"))).alias("upper"), F.max("_n").alias("_n"))
    few = F.col("_n") < 2
    return ends.select(*partition, F.when(few, 0.0).otherwise(F.col("lower")).alias("lower"), F.when(few, 0.0).otherwise(F.col("upper")).alias("upper"))
