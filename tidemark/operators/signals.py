"""Earnings signals over positional lags: a lag counts the rows that are there, one per code and report date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import relative_surprise
from tidemark.session import require_columns


def _by() -> Window:
    return Window.partitionBy("code").orderBy("report_date")


def seasonal_surprise(panel: DataFrame, value: str = "eps", lag: int = 4, window: int = 8, least: int = 4, floor: float = 1e-10) -> DataFrame:
    """Panel with ``unexpected`` (value less its lag), ``deviation`` (its sample deviation over the rows before) and ``sue``.

    A deviation up to ``floor`` times the code's greatest absolute unexpected value (1 at least) counts as none.
    """
    require_columns(panel, ["code", "report_date", value])
    if lag < 1 or least < 2 or window < least:
        raise ValueError("lag >= 1, least >= 2 and window >= least are needed")
    w = _by()
    before = w.rowsBetween(-window, -1)
    out = panel.withColumn("unexpected", F.col(value) - F.lag(value, lag).over(w))
    out = out.withColumn("deviation", F.when(F.count("unexpected").over(before) >= least, F.stddev_samp("unexpected").over(before)))
    most = F.greatest(F.coalesce(F.max(F.abs("unexpected")).over(Window.partitionBy("code")), F.lit(0.0)), F.lit(1.0))
    return out.withColumn("sue", F.when(F.col("deviation") > floor * most, F.col("unexpected") / F.col("deviation")))


def growth(value: str, lag: int = 4) -> Column:
    """The change relative to the lag's absolute value; NULL for a base of 0."""
    base = F.lag(value, lag).over(_by())
    return F.try_divide(F.col(value) - base, F.abs(base))


def earnings_growth(panel: DataFrame, columns: list[str], lag: int = 4) -> DataFrame:
    """Panel with ``{column}_growth``; columns that are missing give NULL."""
    return panel.withColumns({f"{c}_growth": growth(c, lag) if c in panel.columns else F.lit(None).cast("double") for c in columns})


def difference(panel: DataFrame, value: str, name: str, lag: int = 4) -> DataFrame:
    return panel.withColumn(name, F.col(value) - F.lag(value, lag).over(_by()))


def lagged_surprise(panel: DataFrame, value: str, name: str, lag: int = 4) -> DataFrame:
    return panel.withColumn(name, relative_surprise(F.col(value), F.lag(value, lag).over(_by())))


def same_quarter_before(panel: DataFrame, value: str, name: str, months: int = 12) -> DataFrame:
    """The value of exactly ``months`` earlier, by a join on code and month end; NULL if that report is missing."""
    old = panel.groupBy("code", F.last_day(F.add_months("report_date", months)).alias("_q")).agg(F.max(value).alias(name))
    return panel.join(old.withColumnRenamed("code", "_c"), (F.col("code") == F.col("_c")) & (F.col("report_date") == F.col("_q")), "left").drop("_c", "_q")


def analyst_surprise(*_: object) -> DataFrame:
    raise NotImplementedError("there is no source of analyst forecasts")


analyst_revision = revision_breadth = analyst_surprise


def coverage(panel: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, present, share, mean, deviation) per column."""
    rows = panel.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("_i", "_v"))
    names = F.array(*[F.lit(c) for c in columns])
    return rows.groupBy(F.get(names, F.col("_i")).alias("column")).agg(F.count(F.lit(1)).alias("rows"), F.count("_v").alias("present"), F.avg(F.col("_v").isNotNull().cast("double")).alias("share"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("deviation"))
