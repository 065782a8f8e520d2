"""Portfolio measures and construction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import trade_cost
from tidemark.operators.sequence import exact_quantiles, hot_hashes, positions
from tidemark.session import finite, settle


def annualized_return(r: str, per_year: float) -> Column:
    """Compounded over the rows and scaled to a year; NULL if any row loses everything."""
    n = F.count(r)
    return F.when((n > 0) & (F.min(1 + F.col(r)) > 0), F.exp(F.sum(F.ln(1 + F.col(r))) * per_year / n) - 1)


def sharpe(r: str, per_year: float, riskless: float = 0.0) -> Column:
    return F.when((F.count(r) >= 2) & (F.stddev_samp(r) > 0), (F.avg(r) - riskless / per_year) / F.stddev_samp(r) * per_year**0.5)


def tracking_error(active: str, per_year: float) -> Column:
    return F.stddev_samp(active) * per_year**0.5


def information_ratio(active: str, per_year: float) -> Column:
    return F.try_divide(F.avg(active) * per_year, tracking_error(active, per_year))


def nav(returns: DataFrame, keys: list[str], order: str, r: str, name: str) -> DataFrame:
    """The running product of 1 + r per key; a loss of everything stays 0. One row per period, so a key is short."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    gross = 1 + F.col(r)
    return returns.withColumn(name, F.when(F.min(gross).over(w) > 0, F.exp(F.sum(F.when(gross > 0, F.ln(gross))).over(w))).otherwise(0.0))


def fall(navs: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """``navs`` with how far each lies under the highest so far (0 or less)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return navs.withColumn(name, F.try_divide(F.col(value), F.max(value).over(w)) - 1)


def drawdown(navs: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """(keys, name): the deepest fall from an earlier high."""
    return fall(navs, keys, order, value, "_dd").groupBy(*keys).agg(F.min("_dd").alias(name))


def long_only(signals: DataFrame, keys: list[str], signal: str, benchmark: str, ident: str, top: float = 0.1) -> DataFrame:
    """Rows with ``weight``: equal among the best ``top`` of those in the benchmark with a signal (one at least), else 0."""
    able = (F.col(benchmark) > 0) & F.col(signal).isNotNull()
    counts = signals.where(able).groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * F.lit(float(top)))).alias("_k"))
    ranked = positions(signals.where(able).select(*keys, ident, signal), keys, [F.col(signal).desc(), F.col(ident)], "_pos", hot_hashes(signals, keys))
    chosen = ranked.join(counts, keys).where("_pos < _k").select(*keys, ident, (1 / F.col("_k")).alias("weight"))
    return signals.join(chosen, [*keys, ident], "left").na.fill(0.0, ["weight"])


def turnover(weights: DataFrame, date: str, ident: str, weight: str) -> DataFrame:
    """(date, turnover): half the absolute changes since the date before; missing weights are 0, as is everything before the first date.

    A weight that vanishes appears as a change on the next date, so the dense grid of dates and names isn't built.
    """
    dates = weights.select(date).distinct()
    step = dates.withColumn("_next", F.lead(date).over(Window.orderBy(date))).withColumn("_prev", F.lag(date).over(Window.orderBy(date)))  # one row per date
    held = weights.groupBy(date, ident).agg(F.sum(F.coalesce(F.col(weight), F.lit(0.0))).alias("_w"))
    moves = held.select(date, ident, F.col("_w").alias("_d")).unionByName(held.join(step, date).where("_next IS NOT NULL").select(F.col("_next").alias(date), ident, (-F.col("_w")).alias("_d")))
    net = moves.groupBy(date, ident).agg(F.sum("_d").alias("_d"))
    return net.groupBy(date).agg((F.sum(F.abs("_d")) / 2).alias("turnover"))


def capacity(rows: DataFrame, keys: list[str], adv: str, weight: str, most: float = 0.1, share: float = 0.05) -> DataFrame:
    """(keys, capacity): the ``share`` quantile of most * adv / weight over positive weights."""
    able = rows.where((F.col(weight) > 0) & F.col(adv).isNotNull()).withColumn("_cap", F.lit(most) * F.col(adv) / F.col(weight))
    return exact_quantiles(able, keys, "_cap", [share], "_q", hot_hashes(able, keys)).select(*keys, F.col("_q")[0].alias("capacity"))


def active_weights(portfolio: DataFrame, benchmark: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, active): portfolio less benchmark weights, a missing side counting as 0."""
    p, b = portfolio.select(*keys, F.col("weight").alias("_p")), benchmark.select(*keys, F.col("weight").alias("_b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return p.join(b, keys, "full_outer").select(*keys, (zero("_p") - zero("_b")).alias("active"))


def side_costs(bought: DataFrame, sold: DataFrame, keys: list[str], value: str, slip: float = 0.0, impact: float = 0.0) -> DataFrame:
    """(keys, cost) of what was bought and sold per key: a key on one side only counts as 0 on the other; a NULL or negative amount gives NULL."""
    b, s = bought.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b")), sold.select(*keys, F.col(value).alias("_s"), F.lit(True).alias("_in_s"))
    both = b.join(s, keys, "full_outer")
    side = lambda v, there: F.when(F.col(there), F.col(v)).otherwise(0.0)
    return both.select(*keys, trade_cost(side("_b", "_in_b"), side("_s", "_in_s"), F.lit(slip), F.lit(impact)).alias("cost"))


def risk_parity(variances: DataFrame, keys: list[str], ident: str, variance: str, most: float = 1.0) -> DataFrame:
    """Weights by inverse volatility, cut at ``most`` and brought to a sum of 1; without a positive variance 0."""
    raw = variances.withColumn("_i", F.when(F.col(variance) > 0, 1 / F.sqrt(variance)).otherwise(0.0))
    total = raw.groupBy(*keys).agg(F.sum("_i").alias("_t"))
    cut = raw.join(total, keys).withColumn("_c", F.least(F.coalesce(F.try_divide("_i", "_t"), F.lit(0.0)), F.lit(float(most))))
    again = cut.groupBy(*keys).agg(F.sum("_c").alias("_u"))
    return cut.join(again, keys).select(*keys, ident, F.coalesce(F.try_divide("_c", "_u"), F.lit(0.0)).alias("weight"))


def _total(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return df.join(df.groupBy(*keys).agg(F.sum(value).alias(name)), keys)


def _scaled(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``value`` brought to a sum of 1 per key; all 0 where there is no positive sum."""
    return _total(df, keys, value, "_sum").withColumn(value, F.when(F.col("_sum") > 0, F.col(value) / F.col("_sum")).otherwise(0.0)).drop("_sum")


def fill_factor(shares: DataFrame, keys: list[str], ident: str, value: str, most: float) -> DataFrame:
    """(keys, _factor): the factor f with which sum(least(most, f * value)) equals 1 over shares that are part of 1; NULL if all reach ``most`` before.

    With the j greatest at the cap, f is (1 - j * most) / (1 - their sum), and the first j whose next share stays under the
    cap is the answer. At most 1 / most shares can be capped, so only so many of a key's greatest ones are added up.
    """
    able = shares.where(F.col(value) > 0).select(*keys, ident, value)
    top = positions(able, keys, [F.col(value).desc(), F.col(ident)], "_j", hot_hashes(able, keys)).where(F.col("_j") <= 1 / most)
    greater = Window.partitionBy(*keys).orderBy("_j").rowsBetween(Window.unboundedPreceding, -1)
    factor = F.try_divide(1 - F.col("_j") * most, 1 - F.coalesce(F.sum(value).over(greater), F.lit(0.0)))
    first = F.min(F.when(F.col("_f") * F.col(value) <= most + 1e-12, F.struct("_j", "_f")))["_f"]
    # with all of them at the cap, what has no cap takes the rest
    rest = 1 - F.sum(value)
    loose = F.when(rest > 1e-12, F.greatest(1 - F.count(F.lit(1)) * most, F.lit(0.0)) / rest)
    return top.withColumn("_f", factor).groupBy(*keys).agg(F.coalesce(first, loose).alias("_factor"))


def apply_constraints(weights: DataFrame, keys: list[str], ident: str, most: float, group: str | None = None, group_most: float | None = None, name_caps: list[str] | None = None, before: str | None = None, most_turnover: float | None = None) -> DataFrame:
    """(keys, ident, weight): long-only weights with a sum of 1 under caps, one after the other.

    Negative and missing weights count as 0. First ``name_caps`` (columns, the least of them; NULL is no cap) cut the weights, which
    are then brought to a sum of 1; then groups above ``group_most`` give their excess to the rest in proportion (names
    without a group have no group cap); then names above ``most`` do; last, with earlier weights in ``before``, the move from them
    is shortened to ``most_turnover`` (half the absolute changes). Caps that can't all hold are reached, and the sum of 1 comes
    first. A portfolio without a positive weight is all 0. Every step is an aggregate or a join, so portfolios may be large.
    """
    columns = [*keys, F.col(ident).alias("_id"), F.greatest(F.coalesce(finite("weight"), F.lit(0.0)), F.lit(0.0)).alias("_w")]
    columns += [F.col(group).alias("_group") if group else F.lit(None).cast("string").alias("_group"), finite(before).alias("_p") if before else F.lit(None).cast("double").alias("_p")]
    rows = weights.select(*columns, F.least(F.col("weight").cast("double"), *[finite(c) for c in name_caps]).alias("_cap") if name_caps else F.lit(None).cast("double").alias("_cap"))
    rows = _scaled(rows.withColumn("_w", F.greatest(F.least("_w", F.coalesce("_cap", "_w")), F.lit(0.0))), keys, "_w")
    if group and group_most is not None:
        rows = settle(rows)
        sums = settle(rows.where("_group IS NOT NULL").groupBy(*keys, "_group").agg(F.sum("_w").alias("_s")))
        shared = sums.join(fill_factor(sums, keys, "_group", "_s", group_most), keys, "left")
        capped = F.coalesce(F.least(F.lit(group_most), F.col("_factor") * F.col("_s")), F.lit(group_most))
        scale = shared.select(*keys, "_group", F.when(F.col("_s") > 0, capped / F.col("_s")).alias("_scale"), F.coalesce("_factor", F.lit(1.0)).alias("_rest"))
        loose = scale.groupBy(*keys).agg(F.max("_rest").alias("_loose"))
        rows = rows.join(scale.drop("_rest"), [*keys, "_group"], "left").join(loose, keys, "left")
        rows = _scaled(rows.withColumn("_w", F.col("_w") * F.when(F.col("_group").isNull(), F.coalesce("_loose", F.lit(1.0))).otherwise(F.coalesce("_scale", F.lit(1.0)))), keys, "_w")
    if most > 0:
        rows = settle(rows)
        rows = rows.join(fill_factor(rows, keys, "_id", "_w", most), keys, "left")
        rows = _scaled(rows.withColumn("_w", F.when(F.col("_w") > 0, F.coalesce(F.least(F.lit(float(most)), F.col("_factor") * F.col("_w")), F.lit(float(most)))).otherwise(0.0)), keys, "_w")
    if before and most_turnover is not None:
        rows = _scaled(rows.withColumn("_p", F.greatest(F.coalesce("_p", F.lit(0.0)), F.lit(0.0))), keys, "_p").withColumn("_move", F.abs(F.col("_w") - F.col("_p")) / 2)
        part = F.when(F.col("_moved") > most_turnover, F.lit(float(most_turnover)) / F.col("_moved")).otherwise(1.0)
        held = F.when(F.col("_any") > 0, F.col("_p") + part * (F.col("_w") - F.col("_p"))).otherwise(0.0)
        rows = _scaled(_total(_total(rows, keys, "_move", "_moved"), keys, "_w", "_any").withColumn("_w", held), keys, "_w")
    return rows.select(*keys, F.col("_id").alias(ident), F.col("_w").alias("weight"))


def best_mix(expected: np.ndarray, cov: np.ndarray, aversion: float, low: np.ndarray, high: np.ndarray, steps: int = 500) -> np.ndarray:
    """Weights in [low, high] with a sum of 1 that maximise expected return less aversion / 2 times variance, by projected gradient.

    Bounds that allow no sum of 1 are widened to those that do.
    """
    low, high = (low, high) if low.sum() <= 1 <= high.sum() else (np.minimum(low, 0.0), np.maximum(high, 1.0))

    def project(v: np.ndarray) -> np.ndarray:
        near, far = (v - high).min() - 1, (v - low).max() + 1
        for _ in range(100):
            mid = (near + far) / 2
            near, far = (mid, far) if np.clip(v - mid, low, high).sum() > 1 else (near, mid)
        return np.clip(v - far, low, high)

    w = project(np.full(len(expected), 1 / len(expected)))
    rate = 1 / (aversion * max(np.linalg.eigvalsh(cov).max(), 1e-12))
    for _ in range(steps):
        w = project(w + rate * (expected - aversion * cov @ w))
    return w


def mean_variance(expected: DataFrame, covariances: DataFrame, key: str, ident: str, value: str = "expected", aversion: float = 5.0, least: float = 0.0, most: float = 1.0) -> DataFrame:
    """(key, ident, weight) per portfolio from (key, ident, expected) and its covariances in long form, (key, i, j, cov).

    A portfolio's matrix is dense, so its names are bounded by what one task can hold (a few thousand); portfolios run in
    parallel. Missing covariances are 0, missing expectations too; names without an expectation row have no weight.
    """
    kinds = f"`{key}` {expected.schema[key].dataType.simpleString()}, `{ident}` {expected.schema[ident].dataType.simpleString()}, weight double"

    def solve(names: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        if names.empty:
            return pd.DataFrame(columns=[key, ident, "weight"])
        names = names.drop_duplicates(ident).sort_values(ident, ignore_index=True)
        at = {n: k for k, n in enumerate(names[ident])}
        cov = np.zeros((len(at), len(at)))
        for i, j, c in zip(pairs["i"], pairs["j"], pairs["cov"]):
            if i in at and j in at and c == c and c is not None:
                cov[at[i], at[j]] = cov[at[j], at[i]] = c
        w = best_mix(names[value].astype(float).fillna(0.0).to_numpy(), cov, aversion, np.full(len(at), least), np.full(len(at), most))
        return pd.DataFrame({key: names[key], ident: names[ident], "weight": w})

    return expected.groupBy(key).cogroup(covariances.groupBy(key)).applyInPandas(solve, kinds)
