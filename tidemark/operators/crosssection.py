"""Cross-sectional transformations.

Group statistics are windows where no group is hot, so that all of them share one exchange; else they are aggregates joined
back, so that a group with a third of all rows is combined on the map side and never gathered. ``hot`` holds the groups that are
too large for one place, as ``hot_hashes`` finds them; None looks for them, which reads the input once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sequence import distinct_ranks, exact_quantiles, hot_hashes
from tidemark.session import settle


def _back(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be NULL."""
    renamed = stats.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in stats.columns if c not in keys])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(renamed, match, "left").drop(*[f"_k_{k}" for k in keys])


def _found(df: DataFrame, keys: list[str], hot: list[int] | None) -> list[int]:
    return hot_hashes(df, keys) if hot is None else hot


def with_stats(df: DataFrame, keys: list[str], stats: dict[str, Column], hot: list[int]) -> DataFrame:
    """``df`` with its groups' aggregates."""
    if not hot:
        return df.withColumns({n: c.over(Window.partitionBy(*keys)) for n, c in stats.items()})
    return _back(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), keys)


def with_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], name: str, hot: list[int]) -> DataFrame:
    if not hot:
        return df.withColumn(name, F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])).over(Window.partitionBy(*keys)))
    return _back(df, exact_quantiles(df, keys, value, probs, name), keys)


def enough(df: DataFrame, keys: list[str], value: str, least: int, hot: list[int] | None = None) -> DataFrame:
    """``value`` set to NULL in groups with fewer than ``least`` values."""
    return with_stats(df, keys, {"_n": F.count(value)}, _found(df, keys, hot)).withColumn(value, F.when(F.col("_n") >= least, F.col(value))).drop("_n")


def winsorize(df: DataFrame, keys: list[str], value: str, name: str, lower: float = 0.01, upper: float = 0.99, hot: list[int] | None = None) -> DataFrame:
    """``value`` clipped to the group's exact quantiles; NULL stays NULL."""
    edged = with_quantiles(df, keys, value, [lower, upper], "_edges", _found(df, keys, hot))
    clipped = F.greatest(F.least(F.col(value), F.col("_edges")[1]), F.col("_edges")[0])
    return edged.withColumn(name, F.when(F.col(value).isNotNull(), clipped)).drop("_edges")


def zscore(df: DataFrame, keys: list[str], value: str, name: str, hot: list[int] | None = None) -> DataFrame:
    """Standard scores with the sample deviation; groups with fewer than two values or no spread give NULL."""
    stats = with_stats(df, keys, {"_m": F.avg(value), "_s": F.stddev_samp(value)}, _found(df, keys, hot))
    return stats.withColumn(name, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def demean(df: DataFrame, keys: list[str], group: str, value: str, name: str, hot: list[int] | None = None) -> DataFrame:
    """``value`` less the mean of its group; a NULL group gives NULL."""
    stats = with_stats(df, [*keys, group], {"_m": F.avg(value)}, _found(df, keys, hot))
    return stats.withColumn(name, F.when(F.col(group).isNotNull(), F.col(value) - F.col("_m"))).drop("_m")


def neutralize(df: DataFrame, keys: list[str], value: str, exposure: str, group: str, name: str, unknown: str = "未知", hot: list[int] | None = None) -> DataFrame:
    """The residual of ``value`` on a constant, ``exposure`` and dummies of ``group``, over complete cases per key.

    In closed form: both sides are taken off their group means, and the slope is one ratio of sums per key.
    """
    hot = _found(df, keys, hot)
    full = df.withColumn("_g", F.coalesce(group, F.lit(unknown))).withColumn("_ok", F.col(value).isNotNull() & F.col(exposure).isNotNull())
    means = with_stats(full, [*keys, "_g"], {"_my": F.avg(F.when(F.col("_ok"), F.col(value))), "_mx": F.avg(F.when(F.col("_ok"), F.col(exposure)))}, hot)
    off = means.withColumn("_y", F.when(F.col("_ok"), F.col(value) - F.col("_my"))).withColumn("_x", F.when(F.col("_ok"), F.col(exposure) - F.col("_mx")))
    sums = with_stats(settle(off) if hot else off, keys, {"_xy": F.sum(F.col("_x") * F.col("_y")), "_xx": F.sum(F.col("_x") * F.col("_x"))}, hot)
    slope = F.coalesce(F.try_divide("_xy", "_xx"), F.lit(0.0))
    return sums.withColumn(name, F.col("_y") - slope * F.col("_x")).drop("_g", "_ok", "_my", "_mx", "_y", "_x", "_xy", "_xx")


def average_rank(df: DataFrame, keys: list[str], value: str, name: str, hot: list[int] | None = None) -> DataFrame:
    """Ranks from 1 with ties averaged; NULLs have none. With ``hot`` empty, as ``hot_hashes`` found it, one sort per key will do."""
    if hot == []:
        rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last()))
        return df.withColumn(name, F.when(F.col(value).isNotNull(), rank + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2))
    ranks = distinct_ranks(df, keys, value).select(*keys, value, (F.col("_below") + (F.col("_ties") + 1) / 2).alias(name))
    return _back(df, ranks, [*keys, value])


def quantile_bucket(df: DataFrame, keys: list[str], value: str, buckets: int, name: str, hot: list[int] | None = None) -> DataFrame:
    """Bucket 1 to n by the group's exact quantiles, edges that coincide merged, right-closed; without two edges NULL."""
    edged = with_quantiles(df, keys, value, [i / buckets for i in range(buckets + 1)], "_edges", _found(df, keys, hot)).withColumn("_edges", F.array_distinct("_edges"))
    inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    at = F.size(F.filter(inner, lambda e: e < F.col(value))) + 1
    return edged.withColumn(name, F.when(F.col(value).isNotNull() & (F.size("_edges") >= 2), at)).drop("_edges")
