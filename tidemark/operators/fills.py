"""Entry and exit fills around suspensions and price limits, and forward returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trade_grid(bars: DataFrame, sessions: DataFrame, horizons: list[int], max_shift: int = 10, flagged: DataFrame | None = None) -> DataFrame:
    """(code, idx, fill) dense over the sessions from a code's first bar on.

    ``fill`` is the struct (idx, close, x_h for each horizon) of the first session from idx to idx + max_shift with a price and no
    limit-up; x_h is (idx, close) of the first session from h sessions after that one to max_shift later with a price and no limit-down. One
    row per code and session, so frames of rows are frames of sessions, and one sort per code serves all horizons.
    """
    from tidemark.operators.bars import limit_moves

    hits = limit_moves(bars, flagged).join(sessions, F.col("date") == F.col("session_date")).select("code", F.col("session_idx").alias("idx"), "close", "hit_up", "hit_down")
    last = sessions.agg(F.max("session_idx")).first()[0]
    spans = hits.groupBy("code").agg(F.min("idx").alias("_a")).select("code", F.explode(F.sequence("_a", F.lit(last))).alias("idx"))
    # from the last session back, the latest free one seen is the next one ahead
    back = Window.partitionBy("code").orderBy(F.desc("idx"))

    def ahead(df: DataFrame, name: str, hit: str, *more: str) -> DataFrame:
        free = F.when(F.col("close").isNotNull() & ~F.col(hit), F.struct("idx", "close", *more))
        seen = df.withColumn("_next", F.last(free, True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        return seen.withColumn(name, F.when(F.col("_next.idx") - F.col("idx") <= max_shift, F.col("_next"))).drop("_next")

    dense = ahead(spans.join(hits, ["code", "idx"], "left"), "_sell", "hit_down")
    dense = dense.withColumns({f"x_{h}": F.lag("_sell", h).over(back) for h in horizons})
    return ahead(dense, "fill", "hit_up", *[f"x_{h}" for h in horizons]).select("code", "idx", "fill")


def resolve_fills(events: DataFrame, grid: DataFrame, sessions: DataFrame, date: str, horizons: list[int]) -> DataFrame:
    """Events with entry_idx, entry_price, entry_shift, entry_blocked and per horizon exit_idx, exit_blocked, ret.

    An exit aims at entry + horizon. Blocked entries have no exits, and those don't count as blocked.
    """
    start = sessions.select(F.col("session_date").alias("_sd"), F.col("session_idx").alias("_start"))
    at = grid.select(F.col("code").alias("_gc"), F.col("idx").alias("_gi"), F.col("fill").alias("_fill"))
    out = events.join(start, F.col(date) == F.col("_sd"), "left").join(at, (F.col("code") == F.col("_gc")) & (F.col("_start") == F.col("_gi")), "left").drop("_sd", "_gc", "_gi")
    out = out.withColumn("entry_idx", F.col("_fill.idx")).withColumn("entry_price", F.col("_fill.close"))
    out = out.withColumn("entry_shift", F.col("entry_idx") - F.col("_start")).withColumn("entry_blocked", F.col("entry_idx").isNull())
    for h in horizons:
        sold = F.col(f"_fill.x_{h}")
        out = out.withColumn(f"exit_idx_{h}", sold.idx).withColumn(f"exit_blocked_{h}", F.col("entry_idx").isNotNull() & sold.idx.isNull())
        out = out.withColumn(f"ret_{h}", F.try_divide(sold.close, F.col("entry_price")) - 1)
    return out.drop("_start", "_fill")


def forward_returns(events: DataFrame, bars: DataFrame, sessions: DataFrame, date: str, horizons: list[int]) -> DataFrame:
    """Events with fwd_ret_h: the close h sessions after ``date`` over the close of ``date``, both exact; else NULL.

    One join for all horizons: the event's sessions are exploded, matched and gathered again.
    """
    closes = bars.join(sessions, F.col("date") == F.col("session_date")).select(F.col("code").alias("_c"), F.col("session_idx").alias("_i"), "close")
    start = sessions.select(F.col("session_date").alias("_sd"), F.col("session_idx").alias("_start"))
    steps = F.array(*[F.lit(h) for h in [0, *horizons]])
    asked = events.select("event_id", "code", F.col(date).alias("_d")).join(start, F.col("_d") == F.col("_sd")).withColumn("_h", F.explode(steps)).withColumn("_at", F.col("_start") + F.col("_h"))
    met = asked.join(closes, (F.col("code") == F.col("_c")) & (F.col("_at") == F.col("_i")))
    wide = met.groupBy("event_id").agg(*[F.max(F.when(F.col("_h") == h, F.col("close"))).alias(f"_p{h}") for h in [0, *horizons]])
    rates = wide.select("event_id", *[(F.try_divide(F.col(f"_p{h}"), F.col("_p0")) - 1).alias(f"fwd_ret_{h}") for h in horizons])
    return events.join(rates, "event_id", "left")


def return_audit(rates: DataFrame, horizons: list[int], prefix: str = "fwd_ret_") -> DataFrame:
    """One row: events, and per horizon the coverage and the mean."""
    columns = [F.count(F.lit(1)).alias("events")]
    for h in horizons:
        columns += [F.avg(F.col(f"{prefix}{h}").isNotNull().cast("double")).alias(f"coverage_{h}"), F.avg(f"{prefix}{h}").alias(f"mean_{h}")]
    return rates.agg(*columns)


def fill_audit(fills: DataFrame, horizons: list[int]) -> DataFrame:
    """One row: events, blocked and deferred shares, the mean shift, and per horizon the coverage and the share of blocked exits; with
    unfilled returns beside them (fwd_ret_h) also the mean of what the fills change."""
    share = lambda c: F.avg(c.cast("double"))
    columns = [F.count(F.lit(1)).alias("events"), share(F.col("entry_blocked")).alias("blocked_rate"), share(F.coalesce(F.col("entry_shift") > 0, F.lit(False))).alias("deferred_rate"), F.avg("entry_shift").alias("mean_shift")]
    for h in horizons:
        columns += [share(F.col(f"ret_{h}").isNotNull()).alias(f"coverage_{h}"), share(F.col(f"exit_blocked_{h}")).alias(f"exit_blocked_rate_{h}")]
        if f"fwd_ret_{h}" in fills.columns:
            columns.append(F.avg(F.col(f"ret_{h}") - F.col(f"fwd_ret_{h}")).alias(f"shift_impact_{h}"))
    return fills.agg(*columns)
