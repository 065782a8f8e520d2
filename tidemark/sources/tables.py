"""Readers of the market tables: canonical codes, repeats counted once, and the readings that hold."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import finite

#: Full-width digits and their plain forms, in order.
WIDE_DIGITS = "".join(chr(0xFF10 + i) for i in range(10))
#: Full-width forms of the printable ASCII characters, and the plain ones.
WIDE_FORMS = "".join(chr(0xFF01 + i) for i in range(94))
PLAIN_FORMS = "".join(chr(0x21 + i) for i in range(94))
#: Calendars up to this many rows are part of the plan (30,000 sessions are over a century).
CALENDAR_ROWS = 30_000


def canonical_code(column: Column | str) -> Column:
    """Six digits: full-width digits to plain ones, everything but digits dropped, zeros on the left. No digit at all: NULL."""
    c = F.col(column) if isinstance(column, str) else column
    digits = F.regexp_replace(F.translate(c, WIDE_DIGITS, "0123456789"), "[^0-9]", "")
    return F.when(F.length(digits) == 0, None).when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)


def plain_name(column: Column | str) -> Column:
    """A name for comparison: plain width, lower case, no white space; blank becomes NULL."""
    c = F.col(column) if isinstance(column, str) else column
    plain = F.lower(F.regexp_replace(F.translate(c, WIDE_FORMS, PLAIN_FORMS), r"[\s\p{Z}\x{200B}\x{FEFF}]+", ""))
    return F.when(F.length(plain) > 0, plain)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as (session_date, session_idx). Up to CALENDAR_ROWS rows are read once and become part of the plan; a longer table stays one."""
    table = read(spark, sf_dir, "trade_calendar").select(F.col("session_date").cast("date").alias("session_date"), F.col("session_idx").cast("int").alias("session_idx")).where("session_date IS NOT NULL")
    rows = table.limit(CALENDAR_ROWS + 1).collect()
    if len(rows) > CALENDAR_ROWS:
        return table.groupBy("session_date").agg(F.min("session_idx").alias("session_idx"))
    held = {}
    for r in rows:
        held[r["session_date"]] = min(r["session_idx"], held.get(r["session_date"], r["session_idx"]))
    days = sorted(held)
    return F.broadcast(spark.createDataFrame(pa.table({"session_date": pa.array(days, pa.date32()), "session_idx": pa.array([held[d] for d in days], pa.int32())})))


def current_readings(prices: DataFrame, columns: list[str]) -> DataFrame:
    """The readings that hold: one per canonical code and ``date``, the one with the latest ``loaded_ts``.

    A NULL ``loaded_ts`` counts as earliest, a tie goes to the greater ``price_id``. Rows without code or ``date`` are no
    readings. The groups are single readings, so a code with a third of all rows is spread like any other.
    """
    keyed = prices.select(canonical_code("code").alias("code"), "date", "loaded_ts", "price_id", *[c for c in columns if c not in ("code", "date", "loaded_ts", "price_id")])
    rest = [c for c in keyed.columns if c not in ("code", "date")]
    newest = F.max(F.struct("loaded_ts", "price_id", *[c for c in rest if c not in ("loaded_ts", "price_id")])).alias("_newest")
    held = keyed.where("code IS NOT NULL AND date IS NOT NULL").groupBy("code", "date").agg(newest)
    return held.select("code", "date", *[F.col(f"_newest.{c}").alias(c) for c in rest if c in columns])


def on_session(df: DataFrame, sessions: DataFrame, ts: str = "date") -> DataFrame:
    """Rows whose day is a session, with ``session_idx`` and ``session_date``."""
    return df.join(sessions, F.col(ts).cast("date") == F.col("session_date"))


def traded(readings: DataFrame) -> DataFrame:
    """Readings with a close and a volume above 0."""
    return readings.where(finite("close").isNotNull() & (finite("volume") > 0))
