"""Cohort backtests of event signals with costs, and scenario sweeps in one plan."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.crosssection import with_quantiles, with_stats
from tidemark.operators.portfolio import annualized_return, fall, information_ratio, nav, sharpe, tracking_error
from tidemark.operators.sequence import exact_quantiles, hot_hashes, positions
from tidemark.session import settle


#: Fixed value: the quantile of the names' capacities that stands for a cohort.
CAPACITY_SHARE = 0.05


@dataclass(frozen=True)
class CostModel:
    """Rates of a round trip of ``aum`` spread evenly over a cohort's selection."""

    aum: float = 1e8
    commission: float = 0.0003
    tax: float = 0.0005
    half_spread: float = 0.0005
    slip: float = 0.05
    impact: float = 0.5
    participation: float = 0.1

    def scaled(self, aum: float | None = None, **changes: float) -> CostModel:
        return replace(self, **({"aum": aum} if aum is not None else {}) | changes)


@dataclass(frozen=True)
class Scenario:
    """One run: which signal and return column, which top share, which costs, and which events (an SQL predicate)."""

    name: str
    signal: str
    outcome: str
    top: float = 0.2
    cost: CostModel = CostModel()
    keep: str = "true"


def prepared(events: DataFrame, scenarios: list[Scenario], entry: str = "tradable_date") -> DataFrame:
    """Events exploded over the scenarios: (scenario, cohort, event_id, signal, ret, adv, vol, cost rates); incomplete or blocked ones left out."""
    usable = events.where("NOT coalesce(entry_blocked, false)") if "entry_blocked" in events.columns else events
    parts = [F.struct(F.lit(s.name).alias("scenario"), F.col(s.signal).cast("double").alias("signal"), F.col(s.outcome).cast("double").alias("ret"), F.lit(s.top).alias("top"), F.coalesce(F.expr(s.keep), F.lit(False)).alias("keep"), *[F.lit(float(v)).alias(f"c_{k}") for k, v in asdict(s.cost).items()]) for s in scenarios]
    long = usable.select("event_id", F.date_format(entry, "yyyy-MM").alias("cohort"), F.col("adv20").alias("adv"), F.col("volatility_20d").alias("vol"), F.explode(F.array(*parts)).alias("_s")).select("*", "_s.*").drop("_s")
    return long.where("keep AND cohort IS NOT NULL AND signal IS NOT NULL AND ret IS NOT NULL")


def cohorts(events: DataFrame, scenarios: list[Scenario], least_names: int = 5) -> DataFrame:
    """Per scenario and cohort: n, k, gross, benchmark, active, the costs, net and capacity.

    The best ceil(top * n) are selected (one at least; ties by event_id) by exact positions, so that a large cohort isn't one
    task. Missing volumes and volatilities are taken as the selection's median; the capacity is the CAPACITY_SHARE quantile
    of what each name can carry.
    """
    keys = ["scenario", "cohort"]
    rows = settle(prepared(events, scenarios))
    hot = hot_hashes(rows, keys)
    sized = with_stats(rows, keys, {"n": F.count(F.lit(1)), "benchmark": F.avg("ret")}, hot).where(F.col("n") >= least_names)
    sized = sized.withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("top") * F.col("n"))).cast("bigint"))
    chosen = positions(sized, keys, [F.col("signal").desc(), F.col("event_id")], "_pos", hot).where("_pos < k")
    chosen = settle(chosen) if hot else chosen
    full = with_quantiles(with_quantiles(chosen, keys, "adv", [0.5], "_adv", hot), keys, "vol", [0.5], "_vol", hot)
    full = full.withColumn("_a", F.coalesce("adv", F.get("_adv", F.lit(0)))).withColumn("_v", F.coalesce("vol", F.get("_vol", F.lit(0)), F.lit(0.0)))
    order = F.col("c_aum") / F.col("k")
    part = F.when(F.col("_a") > 0, F.least(order / F.col("_a"), F.col("c_participation")))
    costed = full.withColumn("_part", part).withColumn("_roof", F.col("c_participation") * F.col("_a") * F.col("k"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    found = costed.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.first("k").alias("k"),
        F.avg("ret").alias("gross"),
        F.first("benchmark").alias("benchmark"),
        (2 * F.first("c_commission")).alias("commission"),
        F.first("c_tax").alias("tax"),
        (2 * zero(F.avg(F.col("c_half_spread") + F.col("c_slip") * F.col("_part")))).alias("slippage"),
        (2 * zero(F.avg(F.col("c_impact") * F.col("_v") * F.sqrt("_part")))).alias("impact"),
        F.count_if(F.col("adv").isNull()).alias("adv_missing"),
        *([] if hot else [F.percentile("_roof", F.lit(CAPACITY_SHARE)).alias("capacity")]),
    )
    if hot:
        found = found.join(exact_quantiles(costed, keys, "_roof", [CAPACITY_SHARE], "_roofs").select(*keys, F.col("_roofs")[0].alias("capacity")), keys, "left")
    total = F.col("commission") + F.col("tax") + F.col("slippage") + F.col("impact")
    return found.withColumn("cost", total).withColumn("active", F.col("gross") - F.col("benchmark")).withColumn("net", F.col("gross") - total)


def metrics(results: DataFrame, keys: list[str], per_year: float = 12.0) -> DataFrame:
    """One row per scenario over its cohorts: returns, risk, drawdowns, hit rates, costs."""
    frame = results.withColumn("net_active", F.col("net") - F.col("benchmark"))
    for r in ("gross", "net"):
        frame = fall(nav(frame, keys, "cohort", r, f"_nav_{r}"), keys, "cohort", f"_nav_{r}", f"_fall_{r}")
    return frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cohorts"),
        F.sum("n").alias("events"),
        F.avg("k").alias("mean_names"),
        annualized_return("gross", per_year).alias("gross_annual"),
        annualized_return("net", per_year).alias("net_annual"),
        annualized_return("benchmark", per_year).alias("benchmark_annual"),
        sharpe("gross", per_year).alias("gross_sharpe"),
        sharpe("net", per_year).alias("net_sharpe"),
        sharpe("benchmark", per_year).alias("benchmark_sharpe"),
        tracking_error("active", per_year).alias("tracking_error"),
        information_ratio("active", per_year).alias("information_ratio"),
        information_ratio("net_active", per_year).alias("net_information_ratio"),
        F.avg((F.col("active") > 0).cast("double")).alias("hit_rate"),
        F.avg((F.col("net") > 0).cast("double")).alias("net_hit_rate"),
        F.avg("cost").alias("mean_cost"),
        (F.avg("cost") * per_year).alias("cost_drag_annual"),
        F.avg(F.lit(2.0)).alias("mean_turnover"),  # a cohort is bought and sold once
        F.avg((F.col("gross") > 0).cast("double")).alias("gross_hit_rate"),
        F.percentile("capacity", F.lit(0.5)).alias("capacity_median"),  # over cohorts, so over months
        F.try_divide(F.sum("adv_missing").cast("double"), F.greatest(F.sum("k"), F.lit(1))).alias("adv_missing_rate"),
        F.min("_fall_gross").alias("gross_drawdown"),
        F.min("_fall_net").alias("net_drawdown"),
    )


def rollup(measures: DataFrame, dimension: str, value: str) -> DataFrame:
    """(dimension, variants, mean, positive share) over scenarios."""
    return measures.groupBy(dimension).agg(F.count(F.lit(1)).alias("variants"), F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("double")).alias("positive_share"))


def verdict(summary: DataFrame) -> DataFrame:
    """Adds ``verdict`` from mean_ic, t_stat, net_annual and net_information_ratio."""
    informative = (F.col("mean_ic") > 0) & (F.col("t_stat") >= 2)
    profitable = (F.col("net_annual") > 0) & (F.col("net_information_ratio") > 0)
    return summary.withColumn("verdict", F.when(informative & profitable, "confirmed").when(informative, "informative, not profitable").when(profitable, "profitable, not informative").otherwise("rejected"))
