"""Raw vendor tables to the canonical ones, by one declarative reader.

A layout names for each canonical column the vendor's column and its kind; which columns must be there; and the key of which
one row is kept. Missing optional columns come out NULL, missing required ones raise ValueError while the plan is built.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import parse_number, strip_exchange, zfill
from tidemark.operators.security import first_per_code
from tidemark.session import require_columns

# The vendors' column names, as (canonical name, vendor's name, kind).
FINANCIALS = [
    ("code", "股票代码", "code"), ("name", "股票简称", "text"), ("eps", "每股收益", "number"), ("revenue", "营业总收入-营业总收入", "number"),
    ("revenue_yoy", "营业总收入-同比增长", "number"), ("net_profit", "净利润-净利润", "number"), ("net_profit_yoy", "净利润-同比增长", "number"),
    ("roe", "净资产收益率", "number"), ("gross_margin", "销售毛利率", "number"), ("bps", "每股净资产", "number"),
    ("ocf_per_share", "每股经营现金流量", "number"), ("industry", "所处行业", "text"), ("latest_notice_date", "最新公告日期", "date"),
]
ANNOUNCEMENTS = [("code", "股票代码", "code"), ("first_scheduled", "首次预约时间", "date"), ("actual_disclosure_date", "实际披露时间", "date")]
SCHEDULE_CHANGE = "变更日期"
BARS_A = [
    ("date", "日期", "date"), ("open", "开盘", "number"), ("high", "最高", "number"), ("low", "最低", "number"), ("close", "收盘", "number"),
    ("volume", "成交量", "number"), ("amount", "成交额", "number"), ("pct_change", "涨跌幅", "number"), ("turnover", "换手率", "number"),
]
BARS_B = [(c, c, "date" if c == "date" else "number") for c in ("date", "open", "high", "low", "close", "volume", "amount", "turnover")]
ACTIONS = [
    ("code", "代码", "code"), ("ex_date", "除权除息日", "date"), ("record_date", "股权登记日", "date"), ("plan_date", "预案公告日", "date"),
    ("progress", "方案进度", "text"), ("_cash", "现金分红-现金分红比例", "number"), ("_shares", "送转股份-送转总比例", "number"),
]
LISTING_SH = [("code", "证券代码", "code"), ("name", "证券简称", "text"), ("list_date", "上市日期", "date")]
LISTING_SZ = [("code", "A股代码", "code"), ("name", "A股简称", "text"), ("list_date", "A股上市日期", "date"), ("board", "板块", "text")]
DELISTING_SH = [("code", "公司代码", "code"), ("name", "公司简称", "text"), ("list_date", "上市日期", "date"), ("delist_date", "暂停上市日期", "date")]
DELISTING_SZ = [("code", "证券代码", "code"), ("name", "证券简称", "text"), ("list_date", "上市日期", "date"), ("delist_date", "终止上市日期", "date")]
NAME_CHANGES = [("code", "证券代码", "code"), ("change_date", "变更日期", "date"), ("name_before", "变更前简称", "text"), ("name_after", "变更后简称", "text")]
EPS_HISTORY = [("report_date", "报告期", "date"), ("eps_raw", "基本每股收益", "number")]
DELISTED, BOTH, SHARES, CASH, OTHER = "退市", "送转+分红", "送转", "分红", "其他"


@dataclass(frozen=True)
class Layout:
    columns: list[tuple[str, str, str]]
    required: list[str] = field(default_factory=list)


def _date(c: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(c.cast("string")).cast("date"), F.try_to_timestamp(c.cast("string"), F.lit("yyyyMMdd")).cast("date"))


def parse(raw: DataFrame, layout: Layout, **constants: Column) -> DataFrame:
    """The canonical columns of a raw table, with further ``constants``."""
    require_columns(raw, layout.required)
    out = []
    for name, source, kind in layout.columns:
        c = F.col(f"`{source}`") if source in raw.columns else F.lit(None)
        read = {"code": zfill, "number": parse_number, "date": _date, "text": lambda x: x.cast("string")}[kind](c)
        out.append(read.alias(name))
    return raw.select(*out, *[v.alias(k) for k, v in constants.items()])


def one_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which should be total."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def _day(report_date: str | Column) -> Column:
    return (F.lit(report_date) if isinstance(report_date, str) else report_date).cast("date")


def financials(raw: DataFrame, report_date: str | Column) -> DataFrame:
    """One row per code and report date; ``report_date`` is that of the whole table, or its column."""
    rows = parse(raw, Layout(FINANCIALS, ["股票代码"]), report_date=_day(report_date))
    return one_per(rows, ["code", "report_date"], [F.col(c).asc_nulls_last() for c in ("name", "eps", "revenue", "net_profit")])


def announcements(raw: DataFrame, report_date: str | Column) -> DataFrame:
    """Rows with an actual disclosure day; ``schedule_changes`` counts the filled change columns."""
    changes = [F.col(f"`{c}`").isNotNull().cast("int") for c in raw.columns if SCHEDULE_CHANGE in c]
    rows = parse(raw, Layout(ANNOUNCEMENTS, ["股票代码", "实际披露时间"]), report_date=_day(report_date), schedule_changes=sum(changes, F.lit(0)))
    return rows.where("actual_disclosure_date IS NOT NULL").withColumn("ann_ts", F.col("actual_disclosure_date"))


def _code(code: str | Column) -> Column:
    return zfill(F.lit(code) if isinstance(code, str) else code)


def bars_a(raw: DataFrame, code: str | Column) -> DataFrame:
    return parse(raw, Layout(BARS_A, ["日期"]), code=_code(code), source=F.lit("a")).where("date IS NOT NULL")


def adjusted_bars(raw: DataFrame, code: str | Column, adjust: str = "hfq") -> DataFrame:
    """Bars that the vendor adjusted, with how in ``adjust``."""
    if adjust not in ("qfq", "hfq"):
        raise ValueError("adjust must be qfq or hfq")
    return bars_a(raw, code).withColumn("adjust", F.lit(adjust))


def spot_quotes(first: DataFrame | None, second: DataFrame | None) -> DataFrame:
    """The first vendor's quotes, or those of the second if it has none: (code, price) with the exchange taken off the symbol."""
    raw = first if first is not None else second
    if raw is None:
        raise ValueError("neither source has quotes")
    return raw.select(strip_exchange(F.col("代码")).alias("code"), parse_number(F.col("最新价")).alias("price")).where("code IS NOT NULL")


def calendar_scan(raw: DataFrame, column: str = "trade_date") -> DataFrame:
    """(session_date, session_idx) from a vendor's calendar; without the named column the first one is taken."""
    days = raw.select(_date(F.col(f"`{column if column in raw.columns else raw.columns[0]}`")).alias("session_date")).where("session_date IS NOT NULL").distinct()
    return days.withColumn("session_idx", F.row_number().over(Window.orderBy("session_date")) - 1)  # one row per session


def bars_b(raw: DataFrame, code: str | Column) -> DataFrame:
    """The other vendor's bars: turnover as a fraction becomes percent, the change is derived from the last known close."""
    rows = parse(raw, Layout(BARS_B, ["date"]), code=_code(code), source=F.lit("b")).where("date IS NOT NULL")
    w = Window.partitionBy("code").orderBy("date")
    known = F.last("close", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    moved = rows.withColumn("turnover", F.col("turnover") * 100).withColumn("_c", known)
    return moved.withColumn("pct_change", (F.try_divide("_c", F.lag("_c").over(w)) - 1) * 100).drop("_c")


def bars_with_fallback(first: DataFrame | None, second: DataFrame | None) -> DataFrame:
    """The first vendor's bars, and those of the second for codes and days that the first lacks; ValueError without either."""
    if first is None and second is None:
        raise ValueError("neither source has bars")
    if first is None or second is None:
        return first if second is None else second
    return first.unionByName(second.join(first.select("code", "date").distinct(), ["code", "date"], "left_anti"), allowMissingColumns=True)


def corporate_actions(raw: DataFrame, report_date: str | Column) -> DataFrame:
    """Amounts per ten shares become amounts per share; a label tells which kinds an action has."""
    rows = parse(raw, Layout(ACTIONS, ["代码"]), report_date=_day(report_date))
    per_share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / 10
    rows = rows.withColumn("cash_dividend_per_share", per_share("_cash")).withColumn("share_ratio", per_share("_shares")).drop("_cash", "_shares")
    shares, cash = F.col("share_ratio") > 0, F.col("cash_dividend_per_share") > 0
    return rows.withColumn("type", F.when(shares & cash, BOTH).when(shares, SHARES).when(cash, CASH).otherwise(OTHER)).where("ex_date IS NOT NULL")


def listings(sh: list[tuple[DataFrame, str]], sz: DataFrame) -> DataFrame:
    """All boards as one table; a code on several boards keeps the first."""
    parts = [parse(t, Layout(LISTING_SH, ["证券代码", "上市日期"]), board=F.lit(board), exchange=F.lit("SH")) for t, board in sh]
    parts.append(parse(sz, Layout(LISTING_SZ, ["A股代码", "A股上市日期"]), exchange=F.lit("SZ")))
    return first_per_code(*parts, date="list_date")


def delistings(sh: DataFrame | None, sz: DataFrame | None, source: str = "all") -> DataFrame:
    if source not in ("all", "SH", "SZ"):
        raise ValueError("source must be all, SH or SZ")
    parts = []
    if source in ("all", "SH"):
        parts.append(parse(sh, Layout(DELISTING_SH, ["公司代码"]), exchange=F.lit("SH"), delist_type=F.lit(DELISTED)))
    if source in ("all", "SZ"):
        parts.append(parse(sz, Layout(DELISTING_SZ, ["证券代码"]), exchange=F.lit("SZ"), delist_type=F.lit(DELISTED)))
    return first_per_code(*parts, date="delist_date")


def name_changes(raw: DataFrame) -> DataFrame:
    """One change per code and day, the last one in the table's order of names."""
    rows = parse(raw, Layout(NAME_CHANGES, [v for _, v, _ in NAME_CHANGES])).where("change_date IS NOT NULL")
    return one_per(rows, ["code", "change_date"], [F.col("name_after").desc_nulls_last(), F.col("name_before").desc_nulls_last()])


def eps_history(raw: DataFrame, code: str | Column, since: int = 2015) -> DataFrame:
    rows = parse(raw, Layout(EPS_HISTORY, ["报告期", "基本每股收益"]), code=_code(code))
    return rows.where(F.year("report_date") >= since)


def attach_disclosure(filings: DataFrame, told: DataFrame, how: str = "inner") -> DataFrame:
    """Filings with their disclosure days by code and report date."""
    return filings.join(told, ["code", "report_date"], how)
