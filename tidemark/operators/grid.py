"""Irregular readings onto a regular grid, by validity intervals cut along the grid's cells.

A reading holds from its time to the next one (a step function). Each interval is cut at the cells it meets; a cell's
value is the time-weighted mean of what held in it, and its coverage the part of the cell in which anything held.

Defined cases: rows without entity, time or value are left out; of readings with one time the greatest value holds; a
cell before the first reading has no row, nor has one after the last unless ``hold_last``; an interval's own
columns are the only ones in the output, so input columns can't clash; an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sequence import SMALL_KEY
from tidemark.operators.validity import versions
from tidemark.session import finite, micros

DAY_MICROS = 86_400_000_000


def to_grid(readings: DataFrame, entity: str, ts: str, value: str, amount: str, sessions: DataFrame, small: int = SMALL_KEY, hot: list[int] | None = None) -> DataFrame:
    """One row per entity and session from its first to its last reading; the cell of a session is its whole day.

    Columns: entity, session_date, n_readings, last_value (the latest in the cell, else carried), mean_value
    (time-weighted), total_amount (NULL without a reading), coverage (0 to 1), status ('observed' or 'filled').
    Readings must lie on sessions. Only the interval ends move between neighbours; entities with many readings are cut
    into chunks, and the cells are summed up with a partial aggregate. ``hot`` names the hashes of such entities if known.
    """
    found = readings.select(F.col(entity).alias("_e"), micros(ts).alias("_from"), finite(value).alias("_v"), finite(amount).alias("_a")).where("_e IS NOT NULL AND _from IS NOT NULL AND _v IS NOT NULL")
    steps = versions(found.groupBy("_e", "_from").agg(F.max("_v").alias("_v"), F.sum("_a").alias("_a")), ["_e"], "_from", small=small, hot=hot)
    day = sessions.select(F.unix_date("session_date").alias("_day"), F.col("session_idx").alias("_idx"))
    start, stop = day.withColumnsRenamed({"_day": "_d0", "_idx": "_i0"}), day.withColumnsRenamed({"_day": "_d1", "_idx": "_i1"})
    per_day = F.lit(DAY_MICROS)
    placed = steps.withColumn("_d0", F.expr(f"CAST(_from DIV {DAY_MICROS} AS INT)")).withColumn("_d1", F.expr(f"CAST(coalesce(_until, _from) DIV {DAY_MICROS} AS INT)")).join(start, "_d0").join(stop, "_d1")
    cut = placed.withColumn("_idx", F.explode(F.sequence("_i0", "_i1"))).join(day, "_idx")
    left, right = F.col("_day").cast("bigint") * per_day, (F.col("_day").cast("bigint") + 1) * per_day
    held = F.greatest(F.least(F.coalesce("_until", right), right) - F.greatest("_from", left), F.lit(0)).cast("double")
    own = F.col("_idx") == F.col("_i0")
    cells = cut.withColumn("_w", held).groupBy("_e", "_day").agg(
        F.count(F.when(own, 1)).alias("n_readings"),
        F.max(F.struct("_from", "_v")).alias("_last"),
        F.sum(F.col("_w") * F.col("_v")).alias("_wv"),
        F.sum("_w").alias("_held"),
        F.sum(F.when(own, F.col("_a"))).alias("total_amount"),
    )
    mean = F.when(F.col("_held") > 0, F.col("_wv") / F.col("_held")).otherwise(F.col("_last._v"))
    return cells.select(F.col("_e").alias(entity), F.date_from_unix_date("_day").alias("session_date"), "n_readings", F.col("_last._v").alias("last_value"), mean.alias("mean_value"), "total_amount", (F.col("_held") / DAY_MICROS).alias("coverage"), F.when(F.col("n_readings") > 0, "observed").otherwise("filled").alias("status"))
