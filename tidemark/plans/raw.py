"""Queries of the sources: tables in the vendors' layouts are made from the market tables and read back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.plans import panel, study
from tidemark.session import finite, use_checkpoints
from tidemark.sources import files, vendors
from tidemark.sources.cache import Store
from tidemark.sources.tables import calendar, canonical_code, plain_name, read
from tidemark.streaming import commits

#: From which day on the first vendor has no bars, and from which year on earnings are wanted.
GAP_FROM, SINCE = "2023-01-01", 2022


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors reach."""
    use_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _text(c: Column, missing: str) -> Column:
    """A number as vendors write it: thousands separated, a sentinel for none."""
    return F.coalesce(F.format_number(c, 4), F.lit(missing))


def _short(code: str | Column = "code") -> Column:
    """A code without its leading zeros."""
    return F.regexp_replace(code, "^0+(?=.)", "")


def raw_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.filings(spark, sf_dir)
    columns = {"股票代码": _short(), "股票简称": F.col("name"), "每股收益": _text(F.col("eps"), "--"), "营业总收入-营业总收入": _text(F.col("revenue"), ""), "净利润-净利润": _text(F.col("net_profit"), "nan"), "所处行业": F.col("industry"), "最新公告日期": F.date_format("actual_disclosure_date", "yyyyMMdd"), "报告期": F.col("report_date")}
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def raw_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.filings(spark, sf_dir)
    moved = F.when(~F.col("first_scheduled").eqNullSafe(F.col("actual_disclosure_date")), F.col("actual_disclosure_date").cast("string"))
    columns = {"股票代码": _short(), "首次预约时间": F.col("first_scheduled").cast("string"), "初次变更日期": moved, "二次变更日期": F.lit(None).cast("string"), "实际披露时间": F.date_format("actual_disclosure_date", "yyyy-MM-dd"), "报告期": F.col("report_date")}
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def vendor_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vendors.financials(raw_financials(spark, sf_dir), F.col("报告期"))
    return rows.select("code", "report_date", "name", "industry", "latest_notice_date", "roe", *[F.round(c, 3).alias(c) for c in ("eps", "revenue", "net_profit")])


def vendor_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendors.announcements(raw_announcements(spark, sf_dir), F.col("报告期"))


def told_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings with their disclosure days."""
    return vendors.attach_disclosure(vendor_financials(spark, sf_dir), vendor_announcements(spark, sf_dir)).select("code", "report_date", "eps", "actual_disclosure_date", "schedule_changes")


def built_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event panel from the vendors' tables: aligned to sessions, listed and unflagged codes only."""
    filed = vendors.financials(raw_financials(spark, sf_dir), F.col("报告期")).withColumn("name", F.upper(plain_name("name")))
    master = study.Master(vendor_listings(spark, sf_dir), vendor_delistings(spark, sf_dir), vendor_renames(spark, sf_dir))
    made = study.event_panel(filed, vendor_announcements(spark, sf_dir), calendar(spark, sf_dir), master)
    return made.select("event_id", "code", "report_date", "actual_disclosure_date", "tradable_date", "flag_basis", "is_flagged")


def _raw_bars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = panel.daily_bars(spark, sf_dir)
    a = rows.where(F.col("date") < GAP_FROM).select(_short().alias("代码"), F.date_format("date", "yyyyMMdd").alias("日期"), _text(F.col("close"), "--").alias("收盘"), _text(F.col("amount"), "--").alias("成交额"), F.col("volume").alias("成交量"), F.col("turnover").alias("换手率"))
    b = rows.select(_short().alias("代码"), F.col("date").cast("string").alias("date"), _text(F.col("close"), "").alias("close"), "amount", "volume", (F.col("turnover") / 100).alias("turnover"))
    return a, b


def vendor_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vendor's bars, the second's where it has none."""
    a, b = _raw_bars(spark, sf_dir)
    both = vendors.bars_with_fallback(vendors.bars_a(a, F.col("代码")), vendors.bars_b(b, F.col("代码")))
    return both.select("code", "date", "source", F.round("close", 3).alias("close"), F.round("amount", 1).alias("amount"), "volume", F.round("turnover", 4).alias("turnover"), F.round("pct_change", 4).alias("pct_change"))


def vendor_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendors.adjusted_bars(_raw_bars(spark, sf_dir)[0], F.col("代码")).select("code", "date", "adjust", F.round("close", 3).alias("close"))


def vendor_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surrogate actions at flagged quotes: the close as cash per ten, shares where the upper limit is over 1.15 of it."""
    raw = read(spark, sf_dir, "feed").where("corporate_action").select(_short(canonical_code("code")).alias("代码"), F.col("date").cast("string").alias("除权除息日"), finite("close").alias("现金分红-现金分红比例"), F.when(finite("limit_up") > 1.15 * finite("close"), finite("limit_up")).alias("送转股份-送转总比例"), F.last_day("date").alias("报告期")).distinct()
    made = vendors.corporate_actions(raw, F.col("报告期"))
    return made.select("code", "report_date", "ex_date", "type", F.round("cash_dividend_per_share", 4).alias("cash_dividend_per_share"), F.round("share_ratio", 4).alias("share_ratio"))


def vendor_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by the day of their first bar: those from 6 on in one table, from 3 on in another under other names; the first table holds."""
    spans = panel.daily_bars(spark, sf_dir).groupBy("code").agg(F.min("date").alias("_d"))
    named = lambda df, c, n, d: df.select(_short().alias(c), F.concat(F.lit(n[0]), "code").alias(n[1:]), F.col("_d").cast("string").alias(d))
    sh = named(spans.where("code >= '600000'"), "证券代码", "S证券简称", "上市日期")
    sz = named(spans.where("code >= '300000' OR code < '200000'").withColumn("_d", F.date_add("_d", 1)), "A股代码", "ZA股简称", "A股上市日期")
    return vendors.listings([(sh, "主板")], sz).select("code", "name", "list_date", "exchange")


def vendor_delistings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bars of codes without one in the calendar's last 40 days, in both tables."""
    gone = panel._lives(spark, sf_dir)[1]
    made = lambda df, c, d: df.select(_short().alias(c), F.col("delist_date").cast("string").alias(d))
    return vendors.delistings(made(gone.where("code >= '600000'"), "公司代码", "暂停上市日期"), made(gone.withColumn("delist_date", F.date_add("delist_date", 2)), "证券代码", "终止上市日期")).select("code", "delist_date", "exchange", "delist_type")


def vendor_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel._renames(spark, sf_dir)
    raw = rows.select(_short().alias("证券代码"), F.col("change_date").cast("string").alias("变更日期"), F.upper("name_before").alias("变更前简称"), F.upper("name_after").alias("变更后简称"))
    return vendors.name_changes(raw)


def vendor_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = panel.filings(spark, sf_dir).select(_short().alias("代码"), F.date_format("report_date", "yyyyMMdd").alias("报告期"), _text(F.col("eps"), "False").alias("基本每股收益"))
    return vendors.eps_history(raw, F.col("代码"), SINCE).select("code", "report_date", F.round("eps_raw", 3).alias("eps_raw"))


def vendor_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "trade_calendar").select(F.date_format("session_date", "yyyyMMdd").alias("日期"))
    return vendors.calendar_scan(days.unionByName(days))


def vendor_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code's last close by its symbol; the first source has failed."""
    last = panel.daily_bars(spark, sf_dir).groupBy("code").agg(F.max_by("close", "date").alias("_c"))
    return vendors.spot_quotes(None, last.select(scalars.exchange_symbol(F.col("code")).alias("代码"), _text(F.col("_c"), "--").alias("最新价"))).withColumn("price", F.round("price", 3))


def code_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol, board and price bands of every code, flagged or not."""
    codes = read(spark, sf_dir, "prices").select(canonical_code("code").alias("code")).where("code IS NOT NULL").distinct()
    c = F.col("code")
    return codes.select("code", scalars.exchange_symbol(c).alias("symbol"), scalars.main_board(c).alias("main_board"), scalars.price_band(c).alias("band"), scalars.price_band(c, F.lit(True)).alias("flagged_band"))


def unseen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that no run has scored."""
    return study.unseen(panel.filings(spark, sf_dir).select("event_id", "code"), read(spark, sf_dir, "engine").select("event_id"))


def audits_beside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-row audits of panel and coverage side by side."""
    one = lambda df, p: df.select(F.lit(1).alias("_one"), *[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    return one(panel.panel_audit(spark, sf_dir), "panel").join(one(panel.coverage_audit(spark, sf_dir), "coverage"), "_one").drop("_one")


def quotes_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes written as JSON and read back, with a digest of the text and whether low <= open, close <= high."""
    rows = read(spark, sf_dir, "feed").select("quote_id", *[finite(c).alias(c) for c in ("open", "high", "low", "close")], "suspended").where("quote_id IS NOT NULL").distinct()
    schema = "quote_id bigint, open double, high double, low double, close double, suspended boolean"
    text = rows.select("quote_id", F.to_json(F.struct(*rows.columns)).alias("_t"))
    back = text.select("quote_id", F.from_json("_t", schema).alias("_q"), F.length(F.sha2("_t", 256)).alias("digest_length"))
    inside = F.forall(F.filter(F.array("_q.open", "_q.close"), lambda x: x.isNotNull()), lambda x: (F.coalesce(F.col("_q.low"), x) <= x) & (x <= F.coalesce(F.col("_q.high"), x)))
    return back.select("quote_id", "_q.open", "_q.close", "_q.suspended", "digest_length", inside.alias("sane"))


def stored_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar fetched once into the store and read from it, then asked for again without a source."""
    store = Store(spark, shared_folder(spark, "store"))
    fetch = lambda **_: read(spark, sf_dir, "trade_calendar").select("session_date", "session_idx").toPandas()  # noqa: E731  # a small, fixed table
    store.get("calendar", {"market": "all"}, fetch, version="1")
    return store.get("calendar", {"market": "all"}).select(F.col("session_date").cast("date").alias("session_date"), F.col("session_idx").cast("int").alias("session_idx"))


def store_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, shared_folder(spark, "store"))
    for name in ("trade_calendar", "subjects"):  # two small, fixed tables
        store.get(name, {"part": "all"}, lambda part, name=name: read(spark, sf_dir, name).toPandas())
    return store.listing().select("interface", "params", "rows", F.size("columns").alias("columns"), F.length("sha256").alias("digits"))


def saved_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filings written by report date and read back."""
    path = shared_folder(spark, "panel")
    files.save_panel(panel.filings(spark, sf_dir).select("event_id", "code", "report_date", "eps"), path, ["report_date"])
    return files.load_panel(spark, path).withColumn("report_date", F.col("report_date").cast("date"))


def saved_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit as CSV and the settings as JSON, read back together."""
    path = shared_folder(spark, "results")
    files.save_csv(panel.panel_audit(spark, sf_dir).select("events", "codes", "periods"), f"{path}/audit")
    files.save_json(spark, files.Settings(), f"{path}/settings.json")
    settings = files.load_json(spark, f"{path}/settings.json")
    return files.load_csv(spark, f"{path}/audit", "events bigint, codes bigint, periods bigint").withColumn("lag", F.lit(settings["lag"])).withColumn("horizons", F.lit(len(settings["horizons"])))


def account_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run as an account, each cohort as its month's snapshot, as a stream until all is read: what is applied, and what is rejected behind a gap."""
    schema = read(spark, sf_dir, "backtest_cohorts").schema
    stream = spark.readStream.schema(schema).option("basePath", sf_dir).parquet(f"{sf_dir}/backtest_cohorts.parque[t]")  # a stream reads a pattern, or a folder, but no single file
    month = F.substring("cohort", 1, 4).cast("int") * 12 + F.substring("cohort", 6, 2).cast("int")
    amount = F.round(F.col("gross_return") * 1e6) / 1e6  # halves as SQL rounds them: of the product, not of the decimal
    snapshots = stream.select(F.col("run_id").cast("string").alias("account"), month.alias("session_idx"), F.coalesce(amount, F.lit(0.0)).alias("amount"), F.col("cohort").alias("payload"))
    path = shared_folder(spark, "commits")
    done = commits.commits(snapshots).select("account", "session_idx", "status", "reason", "balance")
    run = done.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/out").withColumn("balance", F.round("balance", 6))


NAMES = """vendor_financials vendor_announcements told_filings built_panel vendor_bars vendor_adjusted vendor_actions vendor_listings vendor_delistings
vendor_renames vendor_eps vendor_calendar vendor_quotes code_traits unseen_events audits_beside quotes_as_json stored_calendar store_listing
saved_panel saved_results account_commits""".split()
