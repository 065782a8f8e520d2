"""The event panel as one plan: filings and their disclosure days, aligned to sessions, listed and unflagged codes only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import security, sessions
from tidemark.session import require_columns
from tidemark.sources.vendors import attach_disclosure


@dataclass(frozen=True)
class Master:
    """The security master: listings, delistings and name changes."""

    listing: DataFrame
    delisting: DataFrame
    changes: DataFrame


def event_panel(filings: DataFrame, told: DataFrame, calendar: DataFrame, master: Master | None = None, lag: int = 1, flagged: str = "drop") -> DataFrame:
    """One row per code and report date with report_date <= actual_disclosure_date < tradable_date (for lag >= 1).

    ``flagged`` is drop (unknown states stay), keep or ignore. Filings without a disclosure day or without a session
    to trade on are left out. Every step is a join or a filter, so nothing is materialized here.
    """
    if flagged not in ("drop", "keep", "ignore"):
        raise ValueError("flagged must be drop, keep or ignore")
    require_columns(filings, ["code", "report_date"])
    require_columns(told, ["code", "report_date", "actual_disclosure_date"])
    extra = [c for c in told.columns if c not in filings.columns or c in ("code", "report_date")]
    rows = attach_disclosure(filings, told.select(*extra)).where("actual_disclosure_date IS NOT NULL")
    placed = sessions.tradable(rows, "actual_disclosure_date", sessions.day_index(calendar), calendar, lag).where("tradable_date IS NOT NULL")
    placed = placed.withColumn("event_id", F.concat_ws(":", "code", F.date_format("report_date", "yyyy-MM-dd")))
    if master is not None:
        placed = security.listed(placed, master.listing, master.delisting, "actual_disclosure_date")
        if flagged != "ignore":
            placed = security.flag_status(placed, security.name_timeline(master.changes), "actual_disclosure_date", "name")
            placed = security.drop_flagged(placed) if flagged == "drop" else placed
    return placed


def coverage(filings: DataFrame, told: DataFrame) -> DataFrame:
    """One row: filings, announcements, both, either alone, and the matched share of the filings."""
    a = filings.select("code", "report_date").distinct().withColumn("_a", F.lit(1))
    b = told.select("code", "report_date").distinct().withColumn("_b", F.lit(1))
    sums = a.join(b, ["code", "report_date"], "full_outer").agg(F.count("_a").alias("filings"), F.count("_b").alias("announcements"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("matched"))
    return sums.withColumn("filings_only", F.col("filings") - F.col("matched")).withColumn("announcements_only", F.col("announcements") - F.col("matched")).withColumn("match_rate", F.try_divide(F.col("matched").cast("double"), F.col("filings")))


def unseen(events: DataFrame, seen: DataFrame, key: str = "event_id") -> DataFrame:
    """Events that aren't in ``seen``."""
    return events.join(seen.select(key).distinct(), key, "left_anti")
