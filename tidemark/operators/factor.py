"""Factor tests: information coefficients and their statistics, decay, quantile returns, cross-sectional regression."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.crosssection import average_rank, quantile_bucket
from tidemark.operators.sequence import exact_median, hot_hashes
from tidemark.session import settle


def _corr(x: str, y: str) -> Column:
    """Pearson's coefficient by central moments; NULL without spread on either side (no division by zero)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _coefficients(df: DataFrame, keys: list[str], signal: str, outcome: str, least: int, rank: str | None, plain: str | None) -> DataFrame:
    pairs = df.where(F.col(signal).isNotNull() & F.col(outcome).isNotNull()).select(*keys, F.col(signal).alias("_a"), F.col(outcome).alias("_b"))
    if rank:
        hot = hot_hashes(pairs, keys)
        pairs = average_rank(average_rank(settle(pairs) if hot else pairs, keys, "_a", "_ra", hot), keys, "_b", "_rb", hot)
    sums = [_corr(*c).alias(name) for name, c in ((rank, ("_ra", "_rb")), (plain, ("_a", "_b"))) if name]
    found = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), ((F.min("_a") < F.max("_a")) & (F.min("_b") < F.max("_b"))).alias("_spread"), *sums)
    able = (F.col("n") >= least) & F.col("_spread")
    return found.select(*keys, "n", *[F.when(able, F.col(name)).alias(name) for name in (rank, plain) if name])


def ic_by(df: DataFrame, keys: list[str], signal: str, outcome: str, rank: bool = True, least: int = 5) -> DataFrame:
    """(keys, n, ic) over complete pairs per group; NULL for fewer than ``least`` pairs or a constant side."""
    return _coefficients(df, keys, signal, outcome, least, "ic" if rank else None, None if rank else "ic")


def ic_both(df: DataFrame, keys: list[str], signal: str, outcome: str, least: int = 5) -> DataFrame:
    """(keys, n, rank_ic, ic) in one pass."""
    return _coefficients(df, keys, signal, outcome, least, "rank_ic", "ic")


def unpivot(df: DataFrame, keys: list[str], columns: dict[object, str], label: str, value: str) -> DataFrame:
    """One row per key and column: (keys, label, value)."""
    pairs = F.array(*[F.struct(F.lit(k).alias(label), F.col(c).cast("double").alias(value)) for k, c in columns.items()])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*")


def ic_decay(df: DataFrame, signal: str, outcomes: dict[int, str], date: str | None = None) -> DataFrame:
    """(horizon, ic): pooled, or the mean of the dates' coefficients; at least two pairs."""
    present = {h: c for h, c in outcomes.items() if c in df.columns}
    long = unpivot(df, [signal] + ([date] if date else []), present, "horizon", "_r")
    if not date:
        return ic_by(long, ["horizon"], signal, "_r", least=2).select("horizon", "ic")
    return ic_by(long, ["horizon", date], signal, "_r", least=2).groupBy("horizon").agg(F.avg("ic").alias("ic"))


def ic_summary(ics: DataFrame, keys: list[str], order: str, lags: int | None = None, least: int = 3) -> DataFrame:
    """Per key: periods, mean, deviation, icir, t, share above 0, least and greatest. ``lags`` gives Newey-West errors.

    ``ics`` has one row per period, a short table; the lagged products need a window over the periods of a key.
    """
    rows = ics.where("ic IS NOT NULL")
    if not keys:
        keys, rows = ["_all"], rows.withColumn("_all", F.lit(1))
    stats = rows.groupBy(*keys).agg(F.count("ic").alias("periods"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_rate"), F.min("ic").alias("min_ic"), F.max("ic").alias("max_ic"))
    enough = (F.col("periods") >= least) & (F.col("std_ic") > 0)
    out = stats.withColumn("icir", F.when(enough, F.col("mean_ic") / F.col("std_ic")))
    if lags is None:
        return out.withColumn("t_stat", F.when(enough, F.col("mean_ic") / F.col("std_ic") * F.sqrt("periods"))).drop("_all")
    centred = rows.join(stats.select(*keys, "mean_ic", "periods"), keys)
    centred = centred.withColumn("_u", F.col("ic") - F.col("mean_ic"))
    w = Window.partitionBy(*keys).orderBy(order)
    used = F.least(F.lit(lags), F.col("periods") - 1)
    total = F.col("_u") * F.col("_u")
    for k in range(1, lags + 1):
        weight = F.when(F.lit(k) <= used, 1 - F.lit(k) / (used + 1)).otherwise(0.0)
        total = total + 2 * weight * F.coalesce(F.col("_u") * F.lag("_u", k).over(w), F.lit(0.0))
    longrun = centred.withColumn("_t", total).groupBy(*keys).agg((F.sum("_t") / F.first("periods")).alias("_lrv"))
    return out.join(longrun, keys).withColumn("t_stat", F.when((F.col("periods") >= least) & (F.col("_lrv") > 0), F.col("mean_ic") / F.sqrt(F.col("_lrv") / F.col("periods")))).drop("_lrv", "_all")


def quantile_returns(df: DataFrame, keys: list[str], signal: str, outcome: str, buckets: int) -> DataFrame:
    """(keys, bucket, n, mean_ret, median_ret, std_ret) over complete pairs; groups with fewer than 2 per bucket are left out."""
    pairs = df.where(F.col(signal).isNotNull() & F.col(outcome).isNotNull()).select(*keys, signal, outcome)
    wide = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2 * buckets).drop("_n")
    placed = quantile_bucket(pairs.join(wide, keys, "left_semi") if keys else pairs, keys, signal, buckets, "bucket")
    held, by = settle(placed.where("bucket IS NOT NULL")), [*keys, "bucket"]
    sums = held.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("mean_ret"), F.stddev_samp(outcome).alias("std_ret"))
    return sums.join(exact_median(held, by, outcome, "median_ret", hot_hashes(held, by)), by)


def quantile_rollup(quantiles: DataFrame) -> DataFrame:
    """(bucket, mean_ret, periods, n): means of the periods' means."""
    return quantiles.groupBy("bucket").agg(F.avg("mean_ret").alias("mean_ret"), F.count(F.lit(1)).alias("periods"), F.sum("n").alias("n"))


def monotonic(rollup: DataFrame, keys: list[str], bucket: str = "bucket", value: str = "mean_ret", slack: float = 1e-12) -> DataFrame:
    """(keys, monotonic): at least three buckets, none without a value, never falling."""
    w = Window.partitionBy(*keys).orderBy(bucket)
    steps = rollup.withColumn("_d", F.col(value) - F.lag(value).over(w))
    return steps.groupBy(*keys).agg(((F.count(F.lit(1)) >= 3) & F.every(F.col(value).isNotNull()) & F.coalesce(F.every(F.col("_d") >= -slack), F.lit(True))).alias("monotonic"))


def student_t_two_sided(t: float, dof: float) -> float:
    """P(|T| > |t|) by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t) or dof <= 0:
        return math.nan
    x = dof / (dof + t * t)
    a, b = dof / 2, 0.5
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
        h = d
        for m in range(1, 300):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + step * d) or tiny)
                c = (1 + step / c) or tiny
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def regression(df: DataFrame, keys: list[str], outcome: str, features: list[str], group: str | None = None, unknown: str = "未知") -> DataFrame:
    """Ordinary least squares with a constant per key: (keys, term, coef, t_stat, p_value, n).

    The normal equations are sums, so the rows are combined on the map side and only (k + 1)^2 numbers per key reach Python.
    With ``group`` its dummies are among the regressors: both sides are taken off their group means, and the constant has no
    term of its own. Every group that a key has counts as a regressor, also one without a complete case. Keys with fewer
    complete cases than regressors and two are left out.
    """
    full = df if group is None else df.withColumn("_g", F.coalesce(group, F.lit(unknown)))
    counts = None if group is None else full.groupBy(*keys).agg((F.countDistinct("_g") - 1).alias("_dummies"))
    full = full.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [outcome, *features]))
    k, columns, by = len(features), [*features, outcome], keys if group is None else [*keys, "_g"]
    centre = full.groupBy(*by).agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)])
    off = [F.col(c) - F.col(f"_m{i}") for i, c in enumerate(columns)]
    sums = full.join(centre, by).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.first(f"_m{i}") for i in range(k + 1)]).alias("_m"), F.array(*[F.sum(a * b) for a in off for b in off]).alias("_s"))
    sums = sums.withColumn("_dummies", F.lit(0).cast("bigint")) if group is None else sums.join(counts, keys)
    sums = sums.where(F.col("_n") >= k + F.col("_dummies") + 2)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                n, m = r["_n"], np.asarray(r["_m"], float)
                s = np.asarray(r["_s"], float).reshape(k + 1, k + 1)
                inverse = np.linalg.pinv(s[:k, :k])
                beta = inverse @ s[:k, k]
                dof = n - k - 1 - r["_dummies"]
                variance = max(s[k, k] - beta @ s[:k, k], 0.0) / dof
                found = list(zip(features, beta, np.sqrt(np.maximum(variance * np.diag(inverse), 0))))
                if group is None:
                    found.insert(0, ("const", m[k] - m[:k] @ beta, math.sqrt(variance * (1 / n + m[:k] @ inverse @ m[:k]))))
                for name, c, e in found:
                    t = c / e if e > 0 else math.nan
                    rows.append({**{key: r[key] for key in keys}, "term": name, "coef": c, "t_stat": t, "p_value": student_t_two_sided(t, dof), "n": n})
            yield pd.DataFrame(rows, columns=[*keys, "term", "coef", "t_stat", "p_value", "n"])

    found = sums.mapInPandas(solve, f"{kinds}{', ' if kinds else ''}term string, coef double, t_stat double, p_value double, n bigint")
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return found.select(*keys, "term", number("coef"), number("t_stat"), number("p_value"), "n")


def regression_summary(fits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, term, periods, mean_coef, mean_t, share_positive_t, share_significant) over the groups' regressions."""
    return fits.groupBy(*(keys or []), "term").agg(F.count(F.lit(1)).alias("periods"), F.avg("coef").alias("mean_coef"), F.avg("t_stat").alias("mean_t"), F.avg((F.col("t_stat") > 0).cast("double")).alias("share_positive_t"), F.avg((F.col("p_value") < 0.05).cast("double")).alias("share_significant"))
