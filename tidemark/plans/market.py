"""The problems' plans over the market tables that belong to the core: trailing totals, knowledge in time, grids, spikes, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.grid import to_grid
from tidemark.operators.history import history
from tidemark.operators.sequence import exact_median, hot_hashes, lookup
from tidemark.operators.spikes import implausible, with_runs
from tidemark.operators.trailing import Days, Sessions, trailing_totals
from tidemark.operators.validity import as_known
from tidemark.session import finite, micros, settle
from tidemark.sources.tables import calendar, canonical_code, current_readings, on_session, plain_name, read, traded

#: Problem 1: the trailing windows, and the deviations above which a stored value is wrong.
WINDOWS = [Days(7, "7d"), Days(30, "30d"), Sessions(20, "20s")]
ADV_TOLERANCE, RATE_TOLERANCE, LEAST_RETURNS = 0.005, 0.0005, 10


#: Amounts and returns below these are added up in decimals, so that what leaves a window takes off exactly what it brought, however
#: many there are. Greater ones, which no market has, are added up as doubles beside them.
DECIMAL_AMOUNT, DECIMAL_RETURN = 1e24, 1e8
MEASURES = ["amount", "amount_over", "ret", "ret_sq", "ret_over", "ret_sq_over", "log_growth", "ruin", "flip"]


def session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per code and session: amount, and the session's return with what its trailing statistics need."""
    held = on_session(current_readings(read(spark, sf_dir, "prices"), ["amount", "pct_change"]), calendar(spark, sf_dir))
    amount, growth = finite("amount"), 1 + finite("pct_change") / 100
    exact = lambda x, most, kind: F.when(F.abs(x) < most, x).try_cast(kind)
    over = lambda x, most: F.when(F.abs(x) >= most, x)
    total = F.coalesce(F.sum(exact(amount, DECIMAL_AMOUNT, "decimal(28,4)")), F.lit(0)).cast("decimal(38,4)")
    by_day = held.groupBy("code", "session_date").agg(total.alias("amount"), F.sum(over(amount, DECIMAL_AMOUNT)).alias("amount_over"), F.product(growth).alias("_g"))
    g = F.col("_g")
    r, square = g - 1, (g - 1) * (g - 1)
    in_range = lambda x, y: F.when(F.abs(r) < DECIMAL_RETURN, x).otherwise(y)
    return by_day.select(
        "code",
        F.col("session_date").alias("day"),
        "amount",
        "amount_over",
        in_range(r, None).try_cast("decimal(28,18)").alias("ret"),
        in_range(square, None).try_cast("decimal(35,18)").alias("ret_sq"),
        in_range(None, r).alias("ret_over"),
        in_range(None, square).alias("ret_sq_over"),
        F.when(g != 0, F.ln(F.abs(g))).try_cast("decimal(28,18)").alias("log_growth"),
        F.when(g == 0, 1).alias("ruin"),
        F.when(g < 0, 1).alias("flip"),
    )


def p1_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trailing`` with amounts to four decimals, rates to ten, their means to twelve."""
    rows = trailing(spark, sf_dir)
    digits = lambda c: 4 if c.startswith("amount") else 12 if c.startswith("ret_avg") else 10
    return rows.select(*[(F.round(c, digits(c)) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in rows.dtypes])


def trailing(spark: SparkSession, sf_dir: str, windows: list[Days | Sessions] | None = None, on_sessions: bool = False) -> DataFrame:
    """Totals and averages of amount and returns per code and day over 7 and 30 days and 20 sessions, days without trade included.

    Averages of amount count days without activity as 0, those of returns are over the sessions that have one.
    ``n_ret_*`` counts these; fewer than one (two for the deviation) gives NULL.
    """
    windows = WINDOWS if windows is None else windows
    totals = trailing_totals(session_activity(spark, sf_dir), "code", "day", MEASURES, windows, calendar(spark, sf_dir), on_sessions=on_sessions, counted=["ret", "ret_over"])
    columns = ["code", "day", "active", "since", *(["session_idx"] if on_sessions else [])]
    for w in windows:
        both = lambda x: F.col(f"{x}_{w.name}").cast("double") + F.col(f"{x}_over_{w.name}")  # noqa: B023, E731
        n = (F.col(f"n_ret_{w.name}") + F.col(f"n_ret_over_{w.name}")).cast("double")
        amount, total, squares = both("amount"), both("ret"), both("ret_sq")
        spread = F.sqrt(F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0)))
        compound = F.when(F.col(f"ruin_{w.name}") > 0, 0.0).otherwise(F.exp(F.col(f"log_growth_{w.name}").cast("double")) * (1 - 2 * F.pmod(F.col(f"flip_{w.name}"), F.lit(2)))) - 1
        columns += [
            amount.alias(f"amount_{w.name}"),
            (amount / w.length).alias(f"amount_avg_{w.name}"),
            n.cast("bigint").alias(f"n_ret_{w.name}"),
            F.when(n > 0, total).alias(f"ret_{w.name}"),
            F.when(n > 0, total / n).alias(f"ret_avg_{w.name}"),
            F.when(n > 1, spread).alias(f"ret_std_{w.name}"),
            F.when(n > 0, compound).alias(f"compound_{w.name}"),
        ]
    return totals.select(*columns)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored trailing values of ``liquidity`` that the recomputed ones contradict; only the window they need is worked out, on sessions."""
    sessions = calendar(spark, sf_dir)
    totals = trailing(spark, sf_dir, WINDOWS[2:], True).select("code", F.col("day").alias("session_date"), "session_idx", "since", "amount_avg_20s", "n_ret_20s", "ret_std_20s", "compound_20s")
    first = sessions.select(F.col("session_date").alias("since"), F.col("session_idx").alias("_first_idx"))
    right = totals.join(first, "since").where("session_idx - _first_idx >= 20")
    stored = read(spark, sf_dir, "liquidity").select(F.col("liq_id").cast("bigint").alias("liq_id"), canonical_code("code").alias("code"), F.col("date").cast("date").alias("session_date"), *[finite(c).alias(f"_{c}") for c in ("adv20", "volatility_20d", "momentum_20d")])
    off = stored.join(right, ["code", "session_date"])
    wrong_adv = F.abs(F.col("_adv20") - F.col("amount_avg_20s")) > ADV_TOLERANCE * F.abs("amount_avg_20s")
    wrong_vol = (F.col("n_ret_20s") >= LEAST_RETURNS) & (F.abs(F.col("_volatility_20d") - F.col("ret_std_20s")) > RATE_TOLERANCE)
    wrong_mom = F.abs(F.col("_momentum_20d") - F.coalesce("compound_20s", F.lit(0.0))) > RATE_TOLERANCE
    fields = F.array_compact(F.array(F.when(wrong_adv, "adv20"), F.when(wrong_vol, "volatility_20d"), F.when(wrong_mom, "momentum_20d")))
    return off.select("liq_id", F.explode(fields).alias("field")).distinct()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "event_panel").select("event_id", canonical_code("code").alias("code"), "report_date", "actual_disclosure_date", micros("tradable_ts").alias("at"))
    return events.where("event_id IS NOT NULL AND at IS NOT NULL").distinct()


def p3_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the ST state and the correction answer known at its ``tradable_ts``; NULL if nothing was known."""
    found = p3_found(spark, sf_dir)
    st = found.where("attr = 'st'").select("event_id", F.col("row_id").alias("st_row"))
    fix = found.where("attr = 'correction'").select("event_id", F.col("row_id").alias("scan_row"))
    states = read(spark, sf_dir, "sample_audit").select(F.col("序号").alias("st_row"), F.col("当时ST").alias("is_st")).dropDuplicates(["st_row"])
    answers = read(spark, sf_dir, "correction_scan").select(F.col("scan_id").alias("scan_row"), "report_corrected").dropDuplicates(["scan_row"])
    return _events(spark, sf_dir).select("event_id").join(st, "event_id", "left").join(states, "st_row", "left").join(fix, "event_id", "left").join(answers, "scan_row", "left").select("event_id", "st_row", "is_st", "scan_row", "report_corrected")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``sample_audit`` and ``correction_scan`` that held at each event as it was known at its ``tradable_ts``."""
    events = _events(spark, sf_dir)
    states = read(spark, sf_dir, "sample_audit").where(F.col("当时ST").isNotNull()).select(canonical_code("股票代码").alias("code"), F.col("实际披露日").alias("stated"), micros("audit_ts").alias("known"), F.col("序号").cast("bigint").alias("row_id"))
    st = as_known(events.select("event_id", "code", "at", "actual_disclosure_date"), states, ["code"], "at", "known", "row_id", "actual_disclosure_date", "stated")
    scans = read(spark, sf_dir, "correction_scan").where("report_corrected IS NOT NULL").select(canonical_code("code").alias("code"), "report_date", micros("scan_ts").alias("known"), F.col("scan_id").cast("bigint").alias("row_id"))
    fix = as_known(events.select("event_id", "code", "report_date", "at"), scans, ["code", "report_date"], "at", "known", "row_id")
    one = lambda df, attr: df.select("event_id", F.lit(attr).alias("attr"), "row_id")
    return one(st, "st").unionByName(one(fix, "correction")).distinct()


def _traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = traded(current_readings(read(spark, sf_dir, "prices"), ["price_id", "close", "volume"]))
    return held.join(calendar(spark, sf_dir), F.col("date").cast("date") == F.col("session_date"), "left_semi")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(_traded(spark, sf_dir).select("code", "date", "close", "volume"))  # read for hot codes, and for theirs apart from the others
    return to_grid(rows, "code", "date", "close", "volume", calendar(spark, sf_dir), hot=hot_hashes(rows, ["code"]))


def p5_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per code and session between its first and last traded reading, filled and marked where it had none; means to six decimals, coverage to nine, volumes to two."""
    digits = {"mean_value": 6, "coverage": 9, "total_amount": 2}
    rows = _grid(spark, sf_dir)
    return rows.withColumns({c: F.round(c, d) for c, d in digits.items()})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that the grid had to fill."""
    return _grid(spark, sf_dir).where("status = 'filled'").select("code", F.date_format("session_date", "yyyy-MM-dd").alias("session_date"))


#: Problem 6: physical limits of a close, the spike threshold in median changes, the least stuck runs, the band of limit ratios.
LEAST_PRICE, MOST_PRICE, SPIKE_TIMES, STUCK_CLOSES, STUCK_LIMITS, STUCK_ACTIONS, RATIO_BAND = 0.0, 1e6, 12.0, 6, 6, 4, 0.03


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = read(spark, sf_dir, "feed").select(F.col("quote_id").cast("bigint").alias("quote_id"), canonical_code("code").alias("code"), "date", finite("limit_up").alias("limit_up"), finite("limit_down").alias("limit_down"), "suspended", "corporate_action")
    held = quotes.where("suspended = false AND code IS NOT NULL AND date IS NOT NULL").drop("suspended").distinct()
    return held.withColumn("ratio", F.try_divide("limit_up", "limit_down"))


def p6_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every implausible row of ``prices`` and ``feed`` with its reasons. Outliers of ``close`` are sought again after those found are
    taken out (3 passes); ``strict`` is false for those that the log changes of the whole series alone don't show.
    """
    prices = implausible(_traded(spark, sf_dir).drop("volume"), "code", ["date", "price_id"], "close", LEAST_PRICE, MOST_PRICE, SPIKE_TIMES, STUCK_CLOSES)
    quotes = settle(_quotes(spark, sf_dir))
    hot = hot_hashes(quotes, ["code"])
    usual = exact_median(quotes.select("code", "ratio"), ["code"], "ratio", "_usual")
    off = lookup(quotes, usual, ["code"], hot).where((F.col("limit_up") <= 0) | (F.abs(F.col("ratio") / F.col("_usual") - 1) > RATIO_BAND))
    runs = with_runs(quotes.withColumn("_action", F.when(F.col("corporate_action"), True)), ["code"], ["date", "quote_id"], {"_still": (["limit_up", "limit_down"], STUCK_LIMITS), "_again": (["_action"], STUCK_ACTIONS)}, hot=hot)
    stuck = runs.select("code", "quote_id", F.explode(F.array_compact(F.array(F.when(F.col("_still"), "stuck"), F.when(F.col("_again"), "action")))).alias("reason"))
    one = lambda df, tbl, row: df.select(F.lit(tbl).alias("tbl"), "code", F.col(row).cast("bigint").alias("row_id"), "reason", *[c for c in ("in_pass", "strict") if c in df.columns])
    feed = one(off.withColumn("reason", F.lit("limit")), "feed", "quote_id").unionByName(one(stuck, "feed", "quote_id"))
    return one(prices, "prices", "price_id").unionByName(feed.select("*", F.lit(1).alias("in_pass"), F.lit(True).alias("strict"))).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagged rows that are cases by the changes of the whole series, in which only impossible closes are left out."""
    return p6_flags(spark, sf_dir).where("strict").select("tbl", "row_id").distinct()


#: Problem 7: snapshots are taken by month.
MONTHLY = "year(_at) * 12 + month(_at)"


def p7_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every attribute with the period it was valid (NULL end: still valid)."""
    say = lambda attr, at, told, value: F.struct(F.lit(attr).alias("attr"), at.cast("timestamp_ntz").alias("at"), told.cast("timestamp_ntz").alias("told"), value.alias("value"))
    name = say("name", F.col("audit_ts"), F.col("audit_ts"), plain_name("当前简称"))
    at_disclosure = say("name_at_disclosure", F.col("实际披露日"), F.col("audit_ts"), plain_name("披露日当时简称"))
    audits = read(spark, sf_dir, "sample_audit").select(canonical_code("股票代码").alias("entity"), F.explode(F.array(name, at_disclosure)).alias("_s"))
    basis = read(spark, sf_dir, "data_audit").select(F.date_format("report_date", "yyyy-MM-dd").alias("entity"), say("st_basis_sh_current", F.col("run_ts"), F.col("run_ts"), F.col("st_basis_sh_current").cast("string")).alias("_s"))
    # one history for all attributes, keyed by attribute and entity
    rows = audits.unionByName(basis).select(F.when(F.col("entity").isNotNull(), F.concat_ws(":", "_s.attr", "entity")).alias("key"), "_s.at", "_s.told", "_s.value")
    found = history(rows, "key", "at", "value", MONTHLY, "told")
    day = lambda c: F.date_format(F.col(c).cast("date"), "yyyy-MM-dd")
    attr = F.substring_index("key", ":", 1)
    return found.select(F.substring_index("key", ":", -1).alias("entity"), attr.alias("attr"), "value", day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to"), "current")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_versions(spark, sf_dir).select("entity", "attr", "valid_from").distinct()
