"""Column expressions: codes, parsing, boards, price steps, costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code prefixes with their daily price bands, the band of flagged names and of all others.
BANDS = [(("688", "689"), 0.20), (("300", "301"), 0.20), (("8", "4"), 0.30)]
FLAGGED_BAND, USUAL_BAND = 0.05, 0.10
#: Prefixes of the main boards.
MAIN_BOARDS = ("600", "601", "603", "605", "000", "001", "002", "003")
#: Texts that stand for a missing number.
MISSING = ("", "False", "None", "nan", "--")

#: The words that mark a correction in a title, and the reports' names in titles by month and day.
CORRECTION_WORDS = "更正|修订|勘误|补充公告"
REPORT_LABELS = {"03-31": "第一季度报告", "06-30": "半年度报告", "09-30": "第三季度报告", "12-31": "年度报告"}
OTHER_REPORT = "报告"


def zfill(c: Column, width: int = 6) -> Column:
    """Zeros on the left up to ``width``; longer strings stay whole."""
    s = c.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def parse_number(c: Column) -> Column:
    """A double from text with thousands separators; sentinels and anything unreadable give NULL."""
    s = F.trim(c.cast("string"))
    number = F.regexp_replace(s, ",", "").try_cast("double")
    return F.when(s.isin(*MISSING) | F.isnan(number), None).otherwise(number)


def _starts(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def exchange_symbol(code: Column) -> Column:
    """The code with its exchange in front: sh for 6 and 9, bj for 8 and 4, sz for the rest."""
    return F.concat(F.when(_starts(code, ("6", "9")), "sh").when(_starts(code, ("8", "4")), "bj").otherwise("sz"), code)


def strip_exchange(symbol: Column) -> Column:
    return zfill(F.regexp_replace(symbol, "^(sh|sz|bj)", ""))


def price_band(code: Column, flagged: Column | None = None) -> Column:
    """The daily price band of a code; ``flagged`` names have a narrower one on boards without a band of their own."""
    out = F.when(F.lit(False), F.lit(0.0))
    for prefixes, band in BANDS:
        out = out.when(_starts(code, prefixes), band)
    if flagged is not None:
        out = out.when(F.coalesce(flagged, F.lit(False)), FLAGGED_BAND)
    return out.otherwise(USUAL_BAND)


def main_board(code: Column) -> Column:
    return _starts(code, MAIN_BOARDS)


def cents(x: Column) -> Column:
    """Two decimals, a half to the even neighbour."""
    return F.rint(x * 100) / 100


def tick(x: Column) -> Column:
    """Two decimals, a half away from zero, in decimal arithmetic."""
    return F.round(x.cast("decimal(18,6)"), 2).cast("double")


def flagged_name(name: Column) -> Column:
    """Whether a name, white space removed, starts with ST or *ST; NULL stays NULL."""
    plain = F.regexp_replace(name, "[ 　]", "")
    return plain.startswith("ST") | plain.startswith("*ST")


def commission(turnover: Column, rate: float = 0.0003) -> Column:
    return F.when(turnover >= 0, turnover * rate)


def stamp_tax(sold: Column, rate: float = 0.0005) -> Column:
    return F.when(sold >= 0, sold * rate)


def participation(order: Column, adv: Column, cap: float = 0.1) -> Column:
    """The order as a part of daily volume, at most ``cap``; NULL without a positive volume."""
    part = F.when(adv > 0, F.abs(order) / adv)
    return F.when(part.isNotNull(), F.least(part, F.lit(float(cap))))


def slippage(order: Column, adv: Column, cap: float = 0.1, half_spread: float = 0.0005, coefficient: float = 0.05) -> Column:
    return half_spread + coefficient * participation(order, adv, cap)


def market_impact(order: Column, adv: Column, volatility: Column, cap: float = 0.1, coefficient: float = 0.5) -> Column:
    return coefficient * volatility * F.sqrt(participation(order, adv, cap))


def trade_cost(bought: Column, sold: Column, slip: Column, impact: Column, commission_rate: float = 0.0003, tax_rate: float = 0.0005) -> Column:
    """Commission on both sides, tax on sales, slippage and impact on both; a side that is NULL or below 0 gives NULL."""
    both = commission(bought, commission_rate) + commission(sold, commission_rate)
    return both + stamp_tax(sold, tax_rate) + (bought + sold) * (slip + impact)


def order_cap(adv: Column, most: float = 0.1) -> Column:
    """The largest order for a daily volume; 0 where it is missing or negative."""
    if not 0 < most <= 1:
        raise ValueError("the participation must be in (0, 1]")
    return F.when(adv > 0, adv * most).otherwise(0.0)


def surprise(actual: Column, expected: Column, deviation: Column) -> Column:
    """(actual - expected) / deviation for a positive, finite deviation."""
    return F.when((deviation > 0) & (deviation < float("inf")), (actual - expected) / deviation)


def relative_surprise(actual: Column, expected: Column) -> Column:
    return F.try_divide(actual - expected, F.abs(expected))


def report_label(report_date: Column) -> Column:
    """The report's name in titles by its month and day."""
    day = F.date_format(report_date, "MM-dd")
    out = F.when(F.lit(False), "")
    for k, v in REPORT_LABELS.items():
        out = out.when(day == k, v)
    return out.otherwise(OTHER_REPORT)
