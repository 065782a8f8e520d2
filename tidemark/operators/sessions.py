"""Trading-calendar operators. Every shift is an equi-join on dense day and session numbers; no range join is planned."""

from __future__ import annotations

from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of days up to this size (over 100 years) is broadcast.
DAY_ROWS = 40_000


def day_index(sessions: DataFrame, start: str = "1990-01-01", stop: str = "2050-12-31") -> DataFrame:
    """Per calendar day of the span: idx_ge / idx_gt (first session on or after / after), idx_le / idx_lt (last on or before / before), is_session.

    The table has a row per day of the span, whatever the sessions, so it is made once and becomes part of the plan; ``sessions``
    are read for it, at most one per day.
    """
    first, last = (date.fromisoformat(x).toordinal() for x in (start, stop))
    if last - first >= DAY_ROWS:
        raise ValueError(f"a span of at most {DAY_ROWS} days can be indexed")
    own = sessions.select("session_date", "session_idx").distinct().orderBy("session_date").limit(DAY_ROWS).collect()
    at, idx = np.array([r[0].toordinal() for r in own], int), np.array([r[1] for r in own], int)
    days = np.arange(first, last + 1)
    left, right = np.searchsorted(at, days, "left"), np.searchsorted(at, days, "right")

    def numbers(place: np.ndarray) -> pa.Array:
        out = (place < 0) | (place >= len(at))
        return pa.array(np.where(out, 0, idx[np.clip(place, 0, len(at) - 1)] if len(at) else 0), pa.int32(), mask=out)

    epoch = date(1970, 1, 1).toordinal()
    table = {"day": pa.array((days - epoch).astype(np.int32), pa.int32()).cast(pa.date32()), "idx_le": numbers(right - 1), "idx_ge": numbers(left), "is_session": pa.array(left < right), "idx_gt": numbers(right), "idx_lt": numbers(left - 1)}
    return F.broadcast(sessions.sparkSession.createDataFrame(pa.table(table)))


def with_session(df: DataFrame, date: str, sessions: DataFrame, column: str, name: str) -> DataFrame:
    """Join the date of the session number in ``column`` as ``name`` (NULL out of range)."""
    s = sessions.select(F.col("session_idx").alias("_si"), F.col("session_date").alias(name))
    return df.join(s, F.col(column) == F.col("_si"), "left").drop("_si")


def shift(df: DataFrame, date: str, days: DataFrame, sessions: DataFrame, steps: int, name: str) -> DataFrame:
    """The session ``steps`` after the first one on or after the date (before the last one on or before it for negative steps)."""
    base = "idx_ge" if steps >= 0 else "idx_le"
    idx = days.select(F.col("day").alias("_day"), (F.col(base) + steps).alias("_idx"))
    placed = df.join(idx, F.col(date) == F.col("_day"), "left").drop("_day")
    return with_session(placed, date, sessions, "_idx", name).drop("_idx")


def tradable(df: DataFrame, date: str, days: DataFrame, sessions: DataFrame, lag: int = 1, name: str = "tradable_date") -> DataFrame:
    """Lag 0: the first session on or after the date; lag k: the k-th session after it."""
    if lag < 0:
        raise ValueError("lag must not be negative")
    column, more = ("idx_ge", 0) if lag == 0 else ("idx_gt", lag - 1)
    idx = days.select(F.col("day").alias("_day"), (F.col(column) + more).alias("_idx"))
    placed = df.join(idx, F.col(date) == F.col("_day"), "left").drop("_day")
    return with_session(placed, date, sessions, "_idx", name).drop("_idx")


def session_slice(df: DataFrame, start: str, end: str, days: DataFrame, sessions: DataFrame, inclusive: str = "both", name: str = "session_date") -> DataFrame:
    """A row per session from ``start`` to ``end``; none if start > end. ``inclusive`` as in ``sessions_between``."""
    placed = _span(df, start, end, days, inclusive).where("_iz >= _ia").withColumn("_i", F.explode(F.sequence("_ia", "_iz"))).drop("_ia", "_iz")
    return with_session(placed, start, sessions, "_i", name).drop("_i")


def sessions_between(df: DataFrame, start: str, end: str, days: DataFrame, inclusive: str = "both", name: str = "sessions") -> DataFrame:
    """The number of sessions from ``start`` to ``end``; 0 if start > end. ``inclusive`` is both, left, right or neither."""
    out = _span(df, start, end, days, inclusive)
    return out.withColumn(name, F.greatest(F.coalesce(F.col("_iz") - F.col("_ia") + 1, F.lit(0)), F.lit(0))).drop("_ia", "_iz")


def _span(df: DataFrame, start: str, end: str, days: DataFrame, inclusive: str) -> DataFrame:
    """With the numbers of the first and the last session, _ia and _iz."""
    if inclusive not in ("both", "left", "right", "neither"):
        raise ValueError("inclusive must be both, left, right or neither")
    first = "idx_ge" if inclusive in ("both", "left") else "idx_gt"
    final = "idx_le" if inclusive in ("both", "right") else "idx_lt"
    a = days.select(F.col("day").alias("_a"), F.col(first).alias("_ia"))
    z = days.select(F.col("day").alias("_z"), F.col(final).alias("_iz"))
    return df.join(a, F.col(start) == F.col("_a"), "left").join(z, F.col(end) == F.col("_z"), "left").drop("_a", "_z")
