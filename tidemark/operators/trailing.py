"""Rolling totals over trailing periods, by event-contribution deltas.

Each daily amount adds at its day and is taken off again when it leaves the window; the running sum of these deltas is the
total. The sum changes only at deltas, so it is worked out there and carried over the days up to the next one, which
gives days without activity their totals too.

Defined cases: NULL measures contribute nothing; a window in which no measure was present has total 0 (exact for decimals)
and count 0; rows without entity or day are left out; several rows of one entity and day are added up; the output has
columns of its own only, so names in the input can't clash. An empty input gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sessions import day_index


@dataclass(frozen=True)
class Days:
    """A trailing window of calendar days that ends with the day itself."""

    length: int
    name: str


@dataclass(frozen=True)
class Sessions:
    """A trailing window of sessions that ends with the last session not after the day; rows off session don't count."""

    length: int
    name: str


def trailing_totals(daily: DataFrame, entity: str, day: str, measures: list[str], windows: list[Days | Sessions], sessions: DataFrame, until: Column | None = None, on_sessions: bool = False, counted: list[str] | None = None) -> DataFrame:
    """One row per entity and day from its first day to ``until`` (the last session by default): ``{measure}_{window}`` totals and ``n_{measure}_{window}`` counts (of ``counted`` measures, all by default), ``active`` (the day has a row) and ``since`` (the entity's first day).

    ``daily`` should hold one row per entity and day (a partial aggregate of any number of readings), so that an entity has
    as many rows as there are days and no key grows with its readings. Decimal measures make the totals exact.
    ``sessions`` is the calendar (session_date, session_idx), a small table. With ``on_sessions`` only the days of sessions come out, with ``session_idx``.
    """
    ends = sessions.select(F.col("session_idx").alias("_end_idx"), F.col("session_date").alias("_end_date"))
    rows = daily.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(F.col(entity).alias("_e"), F.col(day).cast("date").alias("_d"), *[F.col(m).alias(f"_m_{m}") for m in measures])
    rows = rows.repartition("_e")  # an entity holds a row per day, and all that follows is within it
    with_idx = rows.join(sessions.select(F.col("session_date").alias("_sd"), F.col("session_idx").alias("_si")), F.col("_d") == F.col("_sd"), "left")
    expiries = []
    for i, w in enumerate(windows):
        if isinstance(w, Days):
            expiries.append(F.date_add("_d", w.length))
        else:
            with_idx = with_idx.join(ends.select(F.col("_end_idx").alias(f"_ei{i}"), F.col("_end_date").alias(f"_ed{i}")), F.col("_si") + w.length == F.col(f"_ei{i}"), "left")
            expiries.append(F.col(f"_ed{i}"))
    # kind -1 enters every window, kind i leaves window i
    moments = F.array(F.struct(F.lit(-1).alias("kind"), F.col("_d").alias("at")), *[F.struct(F.lit(i).alias("kind"), x.alias("at")) for i, x in enumerate(expiries)])
    deltas = with_idx.withColumn("_x", F.explode(moments)).where("_x.at IS NOT NULL").withColumn("_at", F.col("_x.at")).withColumn("_kind", F.col("_x.kind"))
    sums, names = [], []
    for i, w in enumerate(windows):
        within = F.lit(True) if isinstance(w, Days) else F.col("_si").isNotNull()
        for m in measures:
            value = F.col(f"_m_{m}")
            signed = lambda v: F.when(within & (F.col("_kind") == -1), v).when(within & (F.col("_kind") == i), -v)  # noqa: B023, E731
            sums.append(F.sum(signed(value)).alias(f"_s_{m}_{w.name}"))
            names.append(f"{m}_{w.name}")
            if counted is None or m in counted:
                sums.append(F.sum(signed(F.when(value.isNotNull(), 1))).alias(f"_s_n_{m}_{w.name}"))
                names.append(f"n_{m}_{w.name}")
    steps = deltas.groupBy("_e", "_at").agg(*sums, F.max(F.when(F.col("_kind") == -1, 1)).alias("_active"))
    in_time = Window.partitionBy("_e").orderBy("_at")
    so_far = in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = sessions.agg(F.max("session_date")).first()[0] if until is None else None
    end = F.lit(last) if until is None else until
    next_at = F.lead("_at").over(in_time)
    totals = steps.select("_e", "_at", F.coalesce(F.date_sub(next_at, 1), F.greatest("_at", end)).alias("_to"), (F.col("_active") == 1).alias("_active"), F.min("_at").over(Window.partitionBy("_e")).alias("_since"), *[F.coalesce(F.sum(f"_s_{n}").over(so_far), F.lit(0)).alias(n) for n in names])
    spread = totals.withColumn("_to", F.least("_to", F.greatest(end, F.lit("1970-01-01").cast("date")))).where("_to >= _at")
    if on_sessions:
        index = day_index(sessions)
        first, final = index.select(F.col("day").alias("_at"), F.col("idx_ge").alias("_i")), index.select(F.col("day").alias("_to"), F.col("idx_le").alias("_j"))
        held = spread.join(first, "_at").join(final, "_to").where("_i <= _j").withColumn("session_idx", F.explode(F.sequence("_i", "_j")))
        days, more = held.join(sessions.select("session_idx", F.col("session_date").alias("_day")), "session_idx"), ["session_idx"]
    else:
        days, more = spread.withColumn("_day", F.explode(F.sequence("_at", "_to"))), []
    return days.select(F.col("_e").alias(entity), F.col("_day").alias(day), (F.coalesce("_active", F.lit(False)) & (F.col("_day") == F.col("_at"))).alias("active"), F.col("_since").alias("since"), *more, *names)
