"""Event-study queries over the market tables: calendar, security master, bars, fills, signals, factor tests, backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import backtest, bars, crosssection, factor, fills, models, portfolio, security, sessions, signals
from tidemark.operators.sequence import hot_hashes, positions
from tidemark.session import finite, settle
from tidemark.sources.tables import calendar, canonical_code, current_readings, on_session, plain_name, read, traded

#: Parameters of the queries: positional lag and window of the surprise, horizons in sessions, least pairs of a coefficient.
LAG, WINDOW, LEAST, HORIZONS, LEAST_PAIRS, BUCKETS = 1, 4, 2, [1, 5, 10, 20, 40, 60], 20, 5
#: Signals of the factor tests and the sweep, the controls of the regressions, and the least events of a subset.
SIGNALS = ["sue", "sue_z", "sue_group", "sue_neutral", "net_profit_growth", "revenue_growth", "eps_growth"]
CONTROLS, LEAST_EVENTS = ["log_mcap", "momentum_20d", "volatility_20d"], 20


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` decimals, without a negative zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per code and session with trade: the day's last close, its sums."""
    held = on_session(traded(current_readings(read(spark, sf_dir, "prices"), ["price_id", "close", "volume", "amount", "turnover"])), calendar(spark, sf_dir))
    total = lambda c, d: F.round(F.sum(finite(c)), d).alias(c)
    return held.groupBy("code", F.col("session_date").alias("date")).agg(F.max_by("close", "date").alias("close"), total("amount", 2), total("volume", 2), total("turnover", 6))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, repeats counted once."""
    columns = [finite(c).alias(c) for c in ("eps", "revenue", "net_profit")]
    rows = read(spark, sf_dir, "event_panel").select("event_id", canonical_code("code").alias("code"), "report_date", "name", "industry", "first_scheduled", "actual_disclosure_date", F.col("tradable_ts").cast("date").alias("tradable_date"), *columns)
    return rows.where("event_id IS NOT NULL").distinct()


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.day_index(calendar(spark, sf_dir))


def calendar_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each disclosure day shifted by 3, 0 and -2 sessions, and whether it is a session."""
    days, cal = _days(spark, sf_dir), calendar(spark, sf_dir)
    out = filings(spark, sf_dir).select("event_id", "actual_disclosure_date")
    for n, name in ((3, "plus3"), (0, "plus0"), (-2, "minus2")):
        out = sessions.shift(out, "actual_disclosure_date", days, cal, n, name)
    on = days.select(F.col("day").alias("_day"), "is_session")
    return out.join(on, F.col("actual_disclosure_date") == F.col("_day"), "left").drop("_day")


def tradable_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, cal = _days(spark, sf_dir), calendar(spark, sf_dir)
    out = filings(spark, sf_dir).select("event_id", "actual_disclosure_date")
    for lag in (0, 1, 2):
        out = sessions.tradable(out, "actual_disclosure_date", days, cal, lag, f"lag{lag}")
    return out


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filings(spark, sf_dir).select("event_id", "report_date", "actual_disclosure_date")
    for how in ("both", "left", "right", "neither"):
        out = sessions.sessions_between(out, "report_date", "actual_disclosure_date", _days(spark, sf_dir), how, how)
    return out.select("event_id", "both", "left", "right", "neither")


def sessions_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per session from an event's disclosure (left out) to 10 days later."""
    spans = filings(spark, sf_dir).select("event_id", "actual_disclosure_date", F.date_add("actual_disclosure_date", 10).alias("_end"))
    return sessions.session_slice(spans, "actual_disclosure_date", "_end", _days(spark, sf_dir), calendar(spark, sf_dir), "right").select("event_id", "session_date")


def panel_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: sizes, spans and violations of report_date <= disclosure < entry."""
    wrong = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    return filings(spark, sf_dir).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("code").alias("codes"), F.countDistinct("report_date").alias("periods"), F.min("report_date").alias("first_report"), F.max("tradable_date").alias("last_entry"), wrong(F.col("report_date") > F.col("actual_disclosure_date")).alias("early"), wrong(F.col("tradable_date") <= F.col("actual_disclosure_date")).alias("late"))


def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far events and audit rows cover each other by code and report date."""
    a = filings(spark, sf_dir).select("code", "report_date").distinct().withColumn("_a", F.lit(1))
    b = read(spark, sf_dir, "sample_audit").select(canonical_code("股票代码").alias("code"), F.col("报告期").alias("report_date")).where("report_date IS NOT NULL").distinct().withColumn("_b", F.lit(1))
    both = a.join(b, ["code", "report_date"], "full_outer")
    return both.agg(F.count("_a").alias("events"), F.count("_b").alias("audited"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("matched"), F.count_if(F.col("_b").isNull()).alias("events_only"), F.count_if(F.col("_a").isNull()).alias("audited_only"))


def _renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.history import history

    audits = read(spark, sf_dir, "sample_audit").select(canonical_code("股票代码").alias("code"), F.col("audit_ts").alias("at"), plain_name("当前简称").alias("name"))
    found = history(audits, "code", "at", "name", "year(_at) * 12 + month(_at)")
    after = found.select("code", F.col("valid_to").alias("_t"), F.col("name").alias("name_before")).where("_t IS NOT NULL")
    starts = found.select("code", F.col("valid_from").alias("_t"), F.col("name").alias("name_after"))
    return after.join(starts, ["code", "_t"]).groupBy("code", F.col("_t").cast("date").alias("change_date")).agg(F.min_by("name_before", "_t").alias("name_before"), F.max_by("name_after", "_t").alias("name_after"))


def names_then(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its code's name at disclosure and the flag that follows from it."""
    timeline = security.name_timeline(_renames(spark, sf_dir))
    events = filings(spark, sf_dir).select("event_id", "code", "actual_disclosure_date", F.upper(plain_name("name")).alias("name"))
    return security.flag_status(events, timeline.withColumn("name", F.upper("name")), "actual_disclosure_date", "name").select("event_id", "name_then", "flag_basis", "is_flagged")


def _lives(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Surrogates of listing and delisting: first bar, and the last bar of codes without one in the last 40 days."""
    spans = daily_bars(spark, sf_dir).groupBy("code").agg(F.min("date").alias("list_date"), F.max("date").alias("_last"))
    end = str(calendar(spark, sf_dir).agg(F.max("session_date")).first()[0])
    return spans.select("code", "list_date"), spans.where(F.col("_last") < F.date_sub(F.lit(end).cast("date"), 40)).select("code", F.col("_last").alias("delist_date"))


def listed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing, delisting = _lives(spark, sf_dir)
    kept = security.listed(filings(spark, sf_dir).select("event_id", "code", "actual_disclosure_date"), listing, delisting, "actual_disclosure_date")
    return security.flag_delisted(kept, delisting, "actual_disclosure_date").select("event_id", "is_delisted")


def survivorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, codes and events later delisted, the codes' share, and what that says of the sample."""
    return rounded(security.survivorship(filings(spark, sf_dir), _lives(spark, sf_dir)[1]))


def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by what their flag rests on."""
    return rounded(security.flag_audit(names_then(spark, sf_dir)))


def unflagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose code wasn't flagged at disclosure; unknown ones stay."""
    return security.drop_flagged(names_then(spark, sf_dir)).select("event_id", "flag_basis", "is_flagged")


def limit_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.limit_moves(daily_bars(spark, sf_dir)).where("hit_up OR hit_down").select("code", "date", "close", "up_price", "down_price", "hit_up", "hit_down"))


def flagged_limit_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``limit_hits`` with the narrower band for codes that ever were flagged."""
    flagged = read(spark, sf_dir, "sample_audit").where(F.col("当时ST")).select(canonical_code("股票代码").alias("code"))
    return rounded(bars.limit_moves(daily_bars(spark, sf_dir), flagged).where("hit_up OR hit_down").select("code", "date", "close", "up_price", "down_price", "hit_up", "hit_down"))


def suspended_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.suspensions(daily_bars(spark, sf_dir), calendar(spark, sf_dir))


def _features() -> list:
    """The features, amounts to four decimals."""
    return [F.round(c, 4).alias(c) if c in ("adv20", "float_mcap") else F.col(c) for c in bars.FEATURES]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Liquidity and momentum features of each bar."""
    return rounded(bars.price_features(daily_bars(spark, sf_dir)).select("code", "date", *_features()), 8)


def features_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the features of the last bar strictly before its entry."""
    events = filings(spark, sf_dir).where("tradable_date IS NOT NULL").select("event_id", "code", "tradable_date")
    priced = bars.price_features(daily_bars(spark, sf_dir)).withColumn("bar_date", F.col("date"))
    done = bars.attach_before(events, priced, "tradable_date", [*bars.FEATURES, "bar_date"])
    return rounded(done.select("event_id", "code", "tradable_date", "bar_date", *_features()), 8)


def adjusted_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back- and forward-adjusted closes over surrogate actions: 0.1 cash and 5 percent shares at each flagged quote."""
    acts = read(spark, sf_dir, "feed").where("corporate_action").select(canonical_code("code").alias("code"), F.col("date").alias("ex_date")).distinct().withColumn("cash_dividend_per_share", F.lit(0.1)).withColumn("share_ratio", F.lit(0.05))
    rows = daily_bars(spark, sf_dir)
    a = bars.adjust(rows, acts, "qfq").select("code", "date", F.col("adj_close").alias("qfq"))
    b = bars.adjust(rows, acts, "hfq").select("code", "date", F.col("adj_close").alias("hfq"))
    return rounded(a.join(b, ["code", "date"]), 4)


def _fills(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    cal = calendar(spark, sf_dir)
    grid = fills.trade_grid(daily_bars(spark, sf_dir) if rows is None else rows, cal, HORIZONS)
    return fills.resolve_fills(filings(spark, sf_dir).where("tradable_date IS NOT NULL"), grid, cal, "tradable_date", HORIZONS)


def filled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [c for h in HORIZONS for c in (f"exit_idx_{h}", f"exit_blocked_{h}", f"ret_{h}")]
    return rounded(_fills(spark, sf_dir).select("event_id", "entry_idx", "entry_price", "entry_shift", "entry_blocked", *columns))


def filled_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(daily_bars(spark, sf_dir))  # read for fills and for plain returns
    plain = fills.forward_returns(filings(spark, sf_dir).where("tradable_date IS NOT NULL").select("event_id", "code", "tradable_date"), rows, calendar(spark, sf_dir), "tradable_date", HORIZONS)
    both = _fills(spark, sf_dir, rows).join(plain.select("event_id", *[f"fwd_ret_{h}" for h in HORIZONS]), "event_id")
    return rounded(fills.fill_audit(both, HORIZONS))


def return_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fills.return_audit(forward_rates(spark, sf_dir), HORIZONS))


def delayed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills of entries one session later."""
    done = _delayed(spark, sf_dir, daily_bars(spark, sf_dir))
    return rounded(done.select("event_id", "entry_idx", *[c for h in (10, 20) for c in (f"exit_idx_{h}", f"ret_{h}")]))


def _delayed(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    cal, days = calendar(spark, sf_dir), _days(spark, sf_dir)
    later = sessions.shift(filings(spark, sf_dir).where("tradable_date IS NOT NULL").select("event_id", "code", "tradable_date"), "tradable_date", days, cal, 1, "later")
    return fills.resolve_fills(later, fills.trade_grid(rows, cal, [10, 20]), cal, "later", [10, 20])


def forward_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = filings(spark, sf_dir).where("tradable_date IS NOT NULL").select("event_id", "code", "tradable_date")
    done = fills.forward_returns(events, daily_bars(spark, sf_dir), calendar(spark, sf_dir), "tradable_date", HORIZONS)
    return rounded(done.select("event_id", *[f"fwd_ret_{h}" for h in HORIZONS]))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = signals.seasonal_surprise(filings(spark, sf_dir), "eps", LAG, WINDOW, LEAST)
    panel = signals.earnings_growth(panel, ["revenue", "net_profit", "eps"], LAG)
    panel = signals.difference(panel, "eps", "eps_change", LAG)
    panel = signals.lagged_surprise(panel, "revenue", "revenue_surprise", LAG)
    panel = signals.same_quarter_before(panel, "revenue", "revenue_year_before")
    return panel.withColumn("sue", F.round("sue", 6))


def seasonal_surprises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surprise over the year before with a deviation over eight reports, four at least (the usual parameters)."""
    panel = signals.seasonal_surprise(filings(spark, sf_dir), "eps")
    panel = signals.earnings_growth(panel, ["revenue", "net_profit"])
    return rounded(panel.select("event_id", "unexpected", "deviation", "sue", "revenue_growth", "net_profit_growth"))


def surprises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_signals(spark, sf_dir).select("event_id", "unexpected", "deviation", "sue", "revenue_growth", "net_profit_growth", "eps_change", "revenue_surprise", "revenue_year_before"))


def signal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.coverage(_signals(spark, sf_dir), ["sue", "revenue_growth", "net_profit_growth"]), 4)


def eps_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the events' eps with the audited ones within 2 percent of the greater of |eps| and 1."""
    audited = read(spark, sf_dir, "sample_audit").select(canonical_code("股票代码").alias("code"), F.col("报告期").alias("report_date"), finite("每股收益").alias("_eps"), F.col("序号").alias("_n")).where("_eps IS NOT NULL")
    last = audited.groupBy("code", "report_date").agg(F.max_by("_eps", "_n").alias("_eps"))
    both = filings(spark, sf_dir).where("eps IS NOT NULL").join(last, ["code", "report_date"]).withColumn("_d", F.abs(F.col("eps") - F.col("_eps")))
    fit = F.col("_d") <= 0.02 * F.greatest(F.abs("eps"), F.lit(1.0))
    return rounded(both.agg(F.count(F.lit(1)).alias("compared"), F.count_if(~fit).alias("mismatches"), F.avg(fit.cast("double")).alias("match_rate"), F.avg("_d").alias("mean_difference"), F.max("_d").alias("max_difference")))


def _analysis(spark: SparkSession, sf_dir: str, delayed: bool = False) -> DataFrame:
    """Events with signals, features before entry and fills; with ``delayed`` also the returns of entries one session later (late_h)."""
    rows = settle(daily_bars(spark, sf_dir))  # read for features and fills
    shorter = lambda df, name, hs: df.select("event_id", *[F.round(f"ret_{h}", 8).alias(f"{name}_{h}") for h in hs])
    filled = _fills(spark, sf_dir, rows)
    done = filled.select("event_id", "entry_blocked", *[F.round(f"ret_{h}", 8).alias(f"ret_{h}") for h in HORIZONS])
    base = _signals(spark, sf_dir).where("tradable_date IS NOT NULL")
    priced = bars.attach_before(base, bars.price_features(rows), "tradable_date", bars.FEATURES)
    out = priced.join(done, "event_id")
    return settle(out.join(shorter(_delayed(spark, sf_dir, rows), "late", (10, 20)), "event_id", "left") if delayed else out)


def _cross(spark: SparkSession, sf_dir: str, delayed: bool = False) -> DataFrame:
    """``_analysis`` with the derived signals, which are NULL in periods with fewer than LEAST_PAIRS surprises."""
    key = ["report_date"]
    rows = _analysis(spark, sf_dir, delayed)
    hot = hot_hashes(rows, key)
    out = crosssection.enough(rows.withColumn("_sue", F.col("sue")), key, "_sue", LEAST_PAIRS, hot)
    out = crosssection.winsorize(out, key, "_sue", "sue_w", hot=hot).drop("_sue")
    out = crosssection.zscore(settle(out) if hot else out, key, "sue_w", "sue_z", hot)
    out = crosssection.demean(out, key, "industry", "sue_w", "sue_group", hot)
    out = crosssection.neutralize(out, key, "sue_w", "log_mcap", "industry", "sue_neutral", hot=hot)
    return out.withColumns({c: F.round(c, 8) for c in ("sue_w", "sue_z", "sue_group", "sue_neutral")})


def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surprise winsorized, standardized, taken off its industry's mean, and neutralized for size and industry."""
    return rounded(_cross(spark, sf_dir).select("event_id", "sue_w", "sue_z", "sue_group", "sue_neutral"), 8)


def recent_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surprise of the last 35 days' events neutralized for size and industry among them alone."""
    rows = _analysis(spark, sf_dir).withColumn("_now", F.lit(1))
    end = rows.agg(F.max("tradable_date")).first()[0]
    recent = rows.where(F.col("tradable_date") > F.date_sub(F.lit(str(end)).try_cast("date"), 35))
    wins = crosssection.winsorize(crosssection.enough(recent, ["_now"], "sue", LEAST_EVENTS), ["_now"], "sue", "sue_w")
    return rounded(crosssection.neutralize(wins, ["_now"], "sue_w", "log_mcap", "industry", "sue_neutral").select("event_id", "sue_w", "sue_neutral"), 8)


def ic_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank and plain coefficients per report date and horizon."""
    long = factor.unpivot(_analysis(spark, sf_dir), ["report_date", "sue"], {h: f"ret_{h}" for h in HORIZONS}, "horizon", "ret")
    return rounded(factor.ic_both(long, ["report_date", "horizon"], "sue", "ret", LEAST_PAIRS))


def ic_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank coefficients of every signal and horizon by report date and by month of entry; thin or constant groups are left out."""
    rows = _cross(spark, sf_dir)
    groups = F.array(F.struct(F.lit("report_date").alias("group_type"), F.col("report_date").cast("string").alias("group")), F.struct(F.lit("entry_month").alias("group_type"), F.date_format("tradable_date", "yyyy-MM").alias("group")))
    placed = rows.withColumn("_g", F.explode(groups)).select("*", "_g.*")
    returns = {h: f"ret_{h}" for h in HORIZONS}
    long = factor.unpivot(placed, ["group_type", "group", *returns.values()], {c: c for c in SIGNALS}, "signal", "_s")
    long = factor.unpivot(long, ["group_type", "group", "signal", "_s"], returns, "horizon", "_r")
    found = factor.ic_by(long, ["signal", "horizon", "group_type", "group"], "_s", "_r", True, LEAST_PAIRS)
    return rounded(found.where("ic IS NOT NULL").withColumnRenamed("n", "n_obs"))


def ic_table_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of ``ic_tables`` per signal, horizon and grouping."""
    return rounded(factor.ic_summary(settle(ic_tables(spark, sf_dir)), ["signal", "horizon", "group_type"], "group"))


def ic_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per horizon: the coefficients' mean, deviation, ratio, t statistics (plain and Newey-West, 2 lags), share above 0."""
    ics = settle(ic_by_period(spark, sf_dir).select("report_date", "horizon", F.col("rank_ic").alias("ic")))
    plain = factor.ic_summary(ics, ["horizon"], "report_date")
    robust = factor.ic_summary(ics, ["horizon"], "report_date", 2).select("horizon", F.col("t_stat").alias("nw_t"))
    return rounded(plain.join(robust, "horizon"), 8)


def decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank coefficients by horizon, pooled and as the mean of the report dates' ones."""
    rows, returns = _analysis(spark, sf_dir), {h: f"ret_{h}" for h in HORIZONS}
    by_date = factor.ic_decay(rows, "sue", returns, "report_date").select("horizon", F.col("ic").alias("mean_ic"))
    return rounded(factor.ic_decay(rows, "sue", returns).join(by_date, "horizon", "left"))


def _quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor.quantile_returns(_analysis(spark, sf_dir), ["report_date"], "sue", "ret_10", BUCKETS)


def quantile_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_quantiles(spark, sf_dir))


def quantile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = settle(factor.quantile_rollup(_quantiles(spark, sf_dir)).withColumn("_all", F.lit(1)))
    return rounded(rolled.join(factor.monotonic(rolled, ["_all"]), "_all").drop("_all"))


def _regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per report date the 10-session return on the surprise and the controls, without and with industries."""
    rows = _analysis(spark, sf_dir)
    fit = lambda spec, group: factor.regression(rows, ["report_date"], "ret_10", ["sue", *CONTROLS], group).withColumn("spec", F.lit(spec))
    return fit("numeric", None).unionByName(fit("numeric+industry", "industry"))


def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surprise's coefficient in ``_regressions``."""
    return rounded(_regressions(spark, sf_dir).where("term = 'sue'").select("report_date", "spec", "coef", "t_stat", "n"))


def regression_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms with their probabilities."""
    return rounded(_regressions(spark, sf_dir))


def regression_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factor.regression(_analysis(spark, sf_dir), ["report_date"], "ret_10", ["sue"]).where("term = 'sue'").select("report_date", "coef", "t_stat", "n"))


def regression_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factor.regression_summary(_regressions(spark, sf_dir).where("term = 'sue'"), ["spec"]).drop("term"))


COST = backtest.CostModel()
DOUBLE = COST.scaled(commission=0.0006, tax=0.001, half_spread=0.001, slip=0.1, impact=1.0)
SCENARIOS = [
    backtest.Scenario("baseline:baseline", "sue", "ret_20"),
    *[backtest.Scenario(f"aum:1e{e}", "sue", "ret_20", 0.2, COST.scaled(aum=10.0**e)) for e in (7, 8, 9)],
    backtest.Scenario("cost:double", "sue", "ret_20", 0.2, DOUBLE),
    *[backtest.Scenario(f"horizon:{h}", "sue", f"ret_{h}") for h in HORIZONS],
    *[backtest.Scenario(f"signal:{x}", x, "ret_20") for x in SIGNALS],
    *[backtest.Scenario(f"top:{t}", "sue", "ret_20", t) for t in (0.1, 0.2, 0.3)],
    *[backtest.Scenario(f"delay:{h}", "sue", f"late_{h}") for h in (10, 20)],
]


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohorts of all scenarios, those by year and by terciles of size and liquidity over all events among them (subsets of LEAST_EVENTS at least)."""
    rows = _cross(spark, sf_dir, True).withColumn("_all", F.lit(1)).withColumn("year", F.year("tradable_date"))
    rows = settle(rows)
    for column, name in (("log_mcap", "size"), ("log_adv20", "liquidity")):
        rows = crosssection.quantile_bucket(rows, ["_all"], column, 3, name)
    rows = settle(rows)
    runs, base = list(SCENARIOS), lambda part, value: backtest.Scenario(f"{part}:{value}", "sue", "ret_20", keep=f"{part} = {value}")
    sizes = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("value")) for c in ("year", "size", "liquidity")])).alias("_p")).groupBy("_p.part", "_p.value").count()
    held = sizes.where((F.col("count") >= LEAST_EVENTS) & F.col("value").isNotNull()).orderBy("part", "value").collect()  # years and terciles
    return backtest.cohorts(rows, [*runs, *[base(r["part"], r["value"]) for r in held]])


def cohort_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["scenario", "cohort", "n", "k", "gross", "benchmark", "active", "commission", "tax", "slippage", "impact", "cost", "net", "capacity", "adv_missing"]
    return rounded(_sweep(spark, sf_dir).withColumn("capacity", F.round("capacity", 4)).select(*columns), 12)


def scenario_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.metrics(_sweep(spark, sf_dir), ["scenario"]).withColumn("capacity_median", F.round("capacity_median", 4)), 8)


def scenario_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = scenario_metrics(spark, sf_dir).withColumn("dimension", F.substring_index("scenario", ":", 1))
    return rounded(backtest.rollup(measured, "dimension", "net_annual"), 4)


def prediction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel joined with the runs' scores as predictions: their rank coefficients, and the surprise's over the same events, per run and report date."""
    latest = F.max(F.struct("scored_ts", finite("score").alias("score"), "run_id", "event_id")).alias("_l")
    held = read(spark, sf_dir, "engine").where("cand_id IS NOT NULL").groupBy("cand_id").agg(latest).groupBy("_l.run_id", "_l.event_id").agg(F.max("_l.score").alias("prediction"))
    told = settle(_analysis(spark, sf_dir).join(held, "event_id"))
    long = factor.unpivot(told, ["run_id", "report_date", "ret_10"], {"prediction": "prediction", "surprise": "sue"}, "score", "_v")
    return rounded(factor.ic_by(long, ["run_id", "score", "report_date"], "_v", "ret_10", True, LEAST_PAIRS))


def ridge_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward ridge predictions from the surprise alone."""
    return rounded(models.walk_forward(_analysis(spark, sf_dir), ["sue"], "ret_10", "report_date", "ridge", 4, 30), 5)


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event could be bought and sold on its entry day, and why not."""
    rows = daily_bars(spark, sf_dir)
    sides = F.explode(F.array(F.lit("buy"), F.lit("sell")))
    asked = filings(spark, sf_dir).where("tradable_date IS NOT NULL").select("event_id", "code", F.col("tradable_date").alias("date"), sides.alias("side"))
    adv = bars.price_features(rows).select("code", "date", F.col("adv20").alias("adv"))
    return bars.order_checks(asked, bars.suspensions(rows, calendar(spark, sf_dir)), bars.limit_moves(rows), adv, 1e6).select("event_id", "side", "tradable", "reason")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict per horizon from its coefficients and its backtest."""
    ics = ic_statistics(spark, sf_dir).select(F.concat(F.lit("horizon:"), "horizon").alias("scenario"), "mean_ic", "t_stat")
    return backtest.verdict(ics.join(scenario_metrics(spark, sf_dir), "scenario")).select("scenario", "mean_ic", "t_stat", "net_annual", "net_information_ratio", "verdict")


def _monthly_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _analysis(spark, sf_dir).where("NOT entry_blocked").select("event_id", "code", F.date_format("tradable_date", "yyyy-MM").alias("month"), "sue", "adv20", "volatility_20d", F.lit(1.0).alias("in_benchmark"))
    return settle(portfolio.long_only(base, ["month"], "sue", "in_benchmark", "event_id", 0.2))


def selected_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_monthly_weights(spark, sf_dir).where("weight > 0").select("month", "event_id", "weight"))


def monthly_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.turnover(_monthly_weights(spark, sf_dir), "month", "code", "weight"))


def monthly_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.capacity(_monthly_weights(spark, sf_dir), ["month"], "adv20", "weight"), 0)


def monthly_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _monthly_weights(spark, sf_dir)
    sizes = w.groupBy("month").agg(F.count(F.lit(1)).alias("_n"))
    even = w.join(sizes, "month").select("month", "event_id", (1 / F.col("_n")).alias("weight"))
    return rounded(portfolio.active_weights(w.where("weight > 0"), even, ["month", "event_id"]))


def inverse_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _monthly_weights(spark, sf_dir).where("weight > 0").withColumn("variance", F.col("volatility_20d") * F.col("volatility_20d"))
    return rounded(portfolio.risk_parity(rows, ["month"], "event_id", "variance", 0.2))


def capped_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights under caps of a hundred-millionth of the daily volume and 15 percent a name, 40 percent an industry, moved by 60 percent at most from the even weights of the month's names."""
    rows = _monthly_weights(spark, sf_dir).join(filings(spark, sf_dir).select("event_id", "industry"), "event_id")
    sizes = rows.groupBy("month").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(sizes, "month").withColumn("even", 1 / F.col("_n")).withColumn("volume_cap", F.col("adv20") / 1e8)
    return rounded(portfolio.apply_constraints(rows, ["month"], "event_id", 0.15, "industry", 0.4, ["volume_cap"], "even", 0.6))


def round_trip_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per code the cost of having bought its last amount and sold its least average volume; either side may be missing, NULL or negative."""
    bought = read(spark, sf_dir, "prices").select(canonical_code("code").alias("code"), "date", "price_id", "loaded_ts", finite("amount").alias("amount")).where("code IS NOT NULL").groupBy("code").agg(F.max_by("amount", F.struct("date", "loaded_ts", "price_id")).alias("amount"))
    sold = read(spark, sf_dir, "liquidity").select(canonical_code("code").alias("code"), (finite("momentum_20d") * finite("adv20")).alias("amount")).where("code IS NOT NULL").groupBy("code").agg(F.min("amount").alias("amount"))
    return rounded(portfolio.side_costs(bought, sold, ["code"], "amount", 0.001, 0.002), 4)


def trading_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slippage, impact and order cap of a fixed order at each snapshot."""
    rows = read(spark, sf_dir, "liquidity").select("liq_id", finite("adv20").alias("adv20"), finite("volatility_20d").alias("vol")).where("liq_id IS NOT NULL").distinct()
    order = F.lit(1e6)
    slip = scalars.slippage(order, F.col("adv20"))
    impact = scalars.market_impact(order, F.col("adv20"), F.col("vol"))
    return rounded(rows.select("liq_id", slip.alias("slippage"), impact.alias("impact"), scalars.order_cap(F.col("adv20")).alias("cap"), scalars.trade_cost(order, order, slip, impact).alias("cost")), 4)


def title_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections among the titles told within 120 days after disclosure."""
    titles = read(spark, sf_dir, "correction_scan").select("scan_id", canonical_code("code").alias("code"), F.col("scan_ts").cast("date").alias("date"), F.col("correction_titles").alias("title")).where("title IS NOT NULL AND title <> ''").distinct()
    events = filings(spark, sf_dir).where("actual_disclosure_date IS NOT NULL").select("event_id", "code", "report_date", "actual_disclosure_date")
    return security.corrections(events, titles, "actual_disclosure_date").select("event_id", "announcements", "corrections", "report_corrections", "report_corrected", "titles")


def correction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(security.correction_audit(title_corrections(spark, sf_dir)))


def code_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by where they occur: union, intersection and differences of two tables' codes."""
    a = read(spark, sf_dir, "prices").select(canonical_code("code").alias("code")).distinct()
    b = filings(spark, sf_dir).select("code").distinct()
    label = lambda df, s: df.select("code", F.lit(s).alias("part"))
    return label(a.union(b).distinct(), "union").unionByName(label(a.intersect(b), "both")).unionByName(label(a.exceptAll(b), "prices_only")).unionByName(label(b.join(a, "code", "left_anti"), "events_only"))


def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible sample of 60 events for manual review, by hash with a seed (a sampling operator)."""
    return filings(spark, sf_dir).select("event_id", "code", "report_date", F.md5(F.concat("event_id", F.lit(":42"))).alias("_h")).orderBy("_h").limit(60).drop("_h")


def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 of the last month's events by surprise, ties by code (a top-k report)."""
    rows = _signals(spark, sf_dir).where("sue IS NOT NULL AND tradable_date IS NOT NULL")
    end = rows.agg(F.max("tradable_date")).first()[0]
    recent = rows.where(F.col("tradable_date") > F.date_sub(F.lit(str(end)).try_cast("date"), 35))
    return rounded(recent.select("event_id", "code", "sue").orderBy(F.desc("sue"), "code", "event_id").limit(20))


def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward folds over report dates with a purge of 60 days."""
    return models.fold_table(filings(spark, sf_dir).select("event_id", "report_date"), "report_date", 5, 60)


def present_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per feature the share of events that have it."""
    return rounded(signals.coverage(_analysis(spark, sf_dir), ["sue", *bars.FEATURES, "ret_10"]).select("column", "rows", "present", "share"), 4)


def panel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each event in the panel's order of entry day and code, by a sort over ranges."""
    rows = filings(spark, sf_dir).where("tradable_date IS NOT NULL").select("event_id", "code", "tradable_date", F.lit(1).alias("_all"))
    return positions(rows, ["_all"], [F.col("tradable_date"), F.col("code"), F.col("event_id")], "place").drop("_all")


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of the events that have at least half of them."""
    rows = _analysis(spark, sf_dir)
    columns = models.feature_columns(rows, ["sue", "revenue_growth", "net_profit_growth", "eps_growth", *CONTROLS, "log_adv20"])
    return rounded(models.scorable(rows, columns).select("event_id", *columns))


def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the later half of the report dates, imputed and scaled by the medians, means and deviations of the earlier half."""
    rows, columns = _analysis(spark, sf_dir), ["sue", *CONTROLS]
    placed = models.blocks(rows, "report_date", 2)
    scaler = models.Scaler.fit(placed.where("block = 0"), columns)
    return rounded(scaler.apply(placed.where("block = 1")).select("event_id", *[F.col(f"_z_{c}").alias(c) for c in columns]))


def ridge_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _analysis(spark, sf_dir)
    columns = models.feature_columns(rows, ["sue", "revenue_growth", "log_mcap", "momentum_20d", "volatility_20d"])
    return rounded(models.walk_forward(rows, columns, "ret_10", "report_date", "ridge", 4, 30))


def boosted_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["sue", "revenue_growth", "log_mcap", "momentum_20d", "volatility_20d"]
    return rounded(models.walk_forward(models.scorable(_analysis(spark, sf_dir), columns), columns, "ret_10", "report_date", "boosted", 4, 30, trees=30))


NAMES = """daily_bars calendar_shift tradable_dates session_counts sessions_after panel_audit coverage_audit names_then flag_counts unflagged_events
listed_events survivorship limit_hits flagged_limit_hits suspended_sessions features features_before adjusted_closes filled_events filled_audit return_coverage
delayed_entries forward_rates surprises seasonal_surprises signal_coverage eps_check cross_section recent_neutral ic_by_period ic_tables
ic_table_summary ic_statistics decay quantile_periods quantile_summary regressions regression_terms regression_single regression_means
cohort_results scenario_metrics scenario_rollup findings selected_weights monthly_turnover monthly_capacity monthly_active inverse_volatility
capped_weights round_trip_costs prediction_scores ridge_single panel_order feature_matrix scaled_features order_requests trading_costs title_corrections correction_counts code_sets audit_sample
best_candidates split_blocks present_features ridge_predictions boosted_predictions""".split()
