"""Daily bars: features known at the close, limit moves, suspensions, adjustment factors. A code holds one row per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import cents, price_band
from tidemark.session import require_columns

FEATURES = ["prev_close", "adv20", "volatility_20d", "momentum_20d", "float_mcap", "log_mcap", "log_adv20"]


def _by(column: str = "date") -> Window:
    return Window.partitionBy("code").orderBy(column)


def price_features(bars: DataFrame, adv_window: int = 20, momentum_window: int = 20, least: int = 10) -> DataFrame:
    """The close before, average amount, volatility and momentum over rows, free-float value from turnover (percent), and logarithms of positive ones.

    Returns run over the last known close; a window needs ``least`` values.
    """
    require_columns(bars, ["code", "date", "close", "amount", "turnover"])
    w = _by()
    filled = bars.withColumn("_c", F.last("close", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    moved = filled.withColumn("_r", F.try_divide("_c", F.lag("_c").over(w)) - 1)
    recent = w.rowsBetween(1 - adv_window, 0)
    enough = lambda c, v: F.when(F.count(c).over(recent) >= least, v)
    out = moved.withColumns({
        "prev_close": F.lag("close").over(w),
        "adv20": enough("amount", F.avg("amount").over(recent)),
        "volatility_20d": enough("_r", F.stddev_samp("_r").over(recent)),
        "momentum_20d": F.try_divide("close", F.lag("close", momentum_window).over(w)) - 1,
        "float_mcap": F.try_divide("amount", F.nullif("turnover", F.lit(0.0)) / 100),
    })
    positive_log = lambda c: F.when(F.col(c) > 0, F.ln(c))
    return out.withColumn("log_mcap", positive_log("float_mcap")).withColumn("log_adv20", positive_log("adv20")).drop("_c", "_r")


def attach_before(events: DataFrame, bars: DataFrame, date: str, features: list[str]) -> DataFrame:
    """As-of join, strictly backward: each event with the features of its code's last bar before ``date``.

    The days asked for and the bars are merged in order of time, a day asked for before the bar of that day, so that a code holds two
    rows per day at most, however many events it has. Events without a code or date get NULLs.
    """
    held_type = bars.select(F.struct(*features).alias("x")).schema["x"].dataType
    asked = events.select("code", F.col(date).alias("_t")).where("code IS NOT NULL AND _t IS NOT NULL").distinct()
    asked = asked.withColumns({"_kind": F.lit(0), "_bar": F.lit(None).cast(held_type)})
    known = bars.select("code", F.col("date").alias("_t"), F.lit(1).alias("_kind"), F.struct(*features).alias("_bar"))
    w = Window.partitionBy("code").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = asked.unionByName(known).withColumn("_bar", F.last("_bar", True).over(w)).where("_kind = 0").select(F.col("code").alias("_c"), "_t", "_bar")
    return events.join(held, (F.col("code") == F.col("_c")) & (F.col(date) == F.col("_t")), "left").select(*[F.col(f"`{c}`") for c in events.columns], *[F.col(f"_bar.{c}").alias(c) for c in features])


def limit_moves(bars: DataFrame, flagged: DataFrame | None = None, tolerance: float = 0.005) -> DataFrame:
    """Bars with prev_close, limit_up/limit_down prices and hit_up/hit_down; without a previous close nothing is hit."""
    w = _by()
    out = bars.withColumn("prev_close", F.lag("close").over(w))
    if flagged is not None:
        out = out.join(flagged.select("code").distinct().withColumn("_flag", F.lit(True)), "code", "left")
        band = price_band(F.col("code"), F.col("_flag"))
    else:
        band = price_band(F.col("code"))
    out = out.withColumn("up_price", cents(F.col("prev_close") * (1 + band))).withColumn("down_price", cents(F.col("prev_close") * (1 - band)))
    out = out.withColumn("hit_up", F.coalesce(F.col("close") >= F.col("up_price") * (1 - tolerance), F.lit(False)))
    return out.withColumn("hit_down", F.coalesce(F.col("close") <= F.col("down_price") * (1 + tolerance), F.lit(False))).drop("_flag")


def suspensions(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """(code, date) of the sessions between a code's first and last bar that have none; codes with one bar have none."""
    placed = bars.join(sessions, F.col("date") == F.col("session_date")).groupBy("code", "session_idx").agg(F.lit(1).alias("_x")).drop("_x")
    gaps = placed.withColumn("_next", F.lead("session_idx").over(Window.partitionBy("code").orderBy("session_idx"))).where("_next > session_idx + 1")
    missing = gaps.select("code", F.explode(F.sequence(F.col("session_idx") + 1, F.col("_next") - 1)).alias("session_idx"))
    return missing.join(sessions, "session_idx").select("code", F.col("session_date").alias("date"))


def adjust(bars: DataFrame, actions: DataFrame, method: str = "qfq") -> DataFrame:
    """Bars with ``factor`` and ``adj_close`` from (code, ex_date, cash_dividend_per_share, share_ratio).

    k = (previous close - cash) / (1 + ratio) / previous close. ``qfq`` multiplies the k of later ex-dates, ``hfq``
    divides by those up to the date; actions without an earlier bar or with k <= 0 are left out.
    """
    if method not in ("qfq", "hfq"):
        raise ValueError("method must be qfq or hfq")
    acts = actions.where("code IS NOT NULL AND ex_date IS NOT NULL").groupBy("code", "ex_date").agg(F.sum(F.coalesce("cash_dividend_per_share", F.lit(0.0))).alias("_cash"), F.sum(F.coalesce("share_ratio", F.lit(0.0))).alias("_ratio"))
    merged = bars.select("code", "date", F.lit(1).alias("_kind"), "close", F.lit(None).cast("double").alias("_cash"), F.lit(None).cast("double").alias("_ratio")).unionByName(acts.select("code", F.col("ex_date").alias("date"), F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("close"), "_cash", "_ratio"))
    w = Window.partitionBy("code").orderBy("date", "_kind")
    before = F.last("close", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    k = F.when(F.col("_kind") == 0, (F.col("_prev") - F.col("_cash")) / (1 + F.col("_ratio")) / F.col("_prev"))
    logs = merged.withColumn("_prev", F.when(before > 0, before)).withColumn("_k", k).withColumn("_l", F.when(F.col("_k") > 0, F.ln("_k")))
    frame = w.rowsBetween(1, Window.unboundedFollowing) if method == "qfq" else w.rowsBetween(Window.unboundedPreceding, 0)
    total = F.coalesce(F.sum("_l").over(frame), F.lit(0.0))
    factor = F.exp(total if method == "qfq" else -total)
    done = logs.withColumn("factor", factor).where("_kind = 1").select("code", "date", "factor")
    return bars.join(done, ["code", "date"]).withColumn("adj_close", F.col("close") * F.col("factor"))


def order_checks(requests: DataFrame, suspended: DataFrame, moves: DataFrame, liquidity: DataFrame | None = None, least_adv: float = 0.0) -> DataFrame:
    """Requests (code, date, side) with ``tradable`` and ``reason``: suspended blocks both sides, a hit limit the side it locks,
    and a missing or low daily volume any, if ``liquidity`` (code, date, adv) is given. A side other than buy or sell is refused.
    """
    off = suspended.select("code", "date").distinct().withColumn("_off", F.lit(True))
    hit = moves.groupBy("code", "date").agg(F.max("hit_up").alias("_up"), F.max("hit_down").alias("_down"))
    out = requests.join(off, ["code", "date"], "left").join(hit, ["code", "date"], "left")
    thin = F.lit(False)
    if liquidity is not None:
        out = out.join(liquidity.groupBy("code", "date").agg(F.max("adv").alias("_adv")), ["code", "date"], "left")
        thin = F.coalesce(F.col("_adv") < least_adv, F.lit(True))
    side = F.when(F.col("side").isin("buy", "sell"), F.col("side")).otherwise(F.raise_error(F.concat(F.lit("unknown side: "), F.coalesce("side", F.lit("NULL")))))
    reason = F.when(F.col("_off"), "suspended").when((side == "buy") & F.col("_up"), "limit up").when((side == "sell") & F.col("_down"), "limit down").when(thin, "thin")
    return out.withColumn("reason", reason).withColumn("tradable", F.col("reason").isNull()).drop("_off", "_up", "_down", "_adv")


def first_present(df: DataFrame, names: list[str]) -> str:
    """The first of the columns that is there and has any value; ValueError if none has."""
    able = [n for n in names if n in df.columns]
    found = df.agg(*[F.count(n).alias(n) for n in able]).first() if able else {}
    for n in able:
        if found[n]:
            return n
    raise ValueError(f"none of {', '.join(names)} has values")
