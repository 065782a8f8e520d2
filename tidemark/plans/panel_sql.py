"""SQL of the event-study queries, written from their definitions."""

from __future__ import annotations

from tidemark.sources.tables import PLAIN_FORMS, WIDE_FORMS

WIDE = WIDE_FORMS
PLAIN = PLAIN_FORMS.replace("'", "''")

READINGS = r"""
canon AS (SELECT DISTINCT lpad(regexp_replace(translate(code, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g'), 6, '0') AS code, price_id, date, close, volume, amount, turnover, loaded_ts FROM prices),
readings AS (SELECT * FROM canon QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY loaded_ts DESC NULLS LAST, price_id DESC) = 1),
cal AS (SELECT CAST(session_date AS DATE) AS d, session_idx AS i FROM trade_calendar),
bars AS (SELECT code, cal.d AS date, cal.i AS idx, arg_max(close, readings.date) AS close, round(sum(amount), 2) AS amount, round(sum(volume), 2) AS volume, round(sum(turnover), 6) AS turnover FROM readings JOIN cal ON CAST(readings.date AS DATE) = cal.d WHERE close IS NOT NULL AND volume > 0 GROUP BY code, cal.d, cal.i),
ev AS (SELECT DISTINCT event_id, code, report_date, name, industry, actual_disclosure_date AS disc, CAST(tradable_ts AS DATE) AS td, eps, revenue, net_profit FROM event_panel)
"""
HITS = """
band AS (SELECT *, CASE WHEN code LIKE '688%' OR code LIKE '689%' THEN 0.2::DOUBLE WHEN code LIKE '300%' OR code LIKE '301%' THEN 0.2::DOUBLE WHEN code LIKE '8%' OR code LIKE '4%' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS b, lag(close) OVER (PARTITION BY code ORDER BY date) AS pc FROM bars),
lim AS (SELECT *, round_even(pc * (1 + b) * 100, 0) / 100 AS up, round_even(pc * (1 - b) * 100, 0) / 100 AS down FROM band),
hits AS (SELECT *, coalesce(close >= up * (1 - 0.005::DOUBLE), false) AS hit_up, coalesce(close <= down * (1 + 0.005::DOUBLE), false) AS hit_down FROM lim)
"""
FEATURES = """
ret AS (SELECT *, lag(close) OVER w AS prev_close, close / nullif(lag(close) OVER w, 0) - 1 AS r, nullif(lag(close, 20) OVER w, 0) AS c20 FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)),
feat AS (SELECT *, CASE WHEN count(amount) OVER w >= 10 THEN avg(amount) OVER w END AS adv20, CASE WHEN count(r) OVER w >= 10 THEN stddev_samp(r) OVER w END AS volatility_20d, close / c20 - 1 AS momentum_20d, amount / (nullif(turnover, 0) / 100) AS float_mcap FROM ret WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
logs AS (SELECT *, CASE WHEN float_mcap > 0 THEN ln(float_mcap) END AS log_mcap, CASE WHEN adv20 > 0 THEN ln(adv20) END AS log_adv20 FROM feat)
"""
HORIZONS = (1, 5, 10, 20, 40, 60)


def fills(name: str, start: str, horizons: tuple[int, ...]) -> str:
    """CTEs that end in ``name``: entries from session ``start`` (an expression over cal.i) and exits of the horizons."""
    exits = ",\n".join(f"{name}_x{h} AS (SELECT en.event_id, (SELECT min(q.idx) FROM hits q WHERE q.code = en.code AND q.idx BETWEEN en.e + {h} AND en.e + {h} + 10 AND NOT q.hit_down) AS x FROM {name}_e en)" for h in horizons)
    columns = ", ".join(f"x{h}.x AS exit_idx_{h}, e IS NOT NULL AND x{h}.x IS NULL AS exit_blocked_{h}, b{h}.close / b0.close - 1 AS ret_{h}" for h in horizons)
    joins = " ".join(f"JOIN {name}_x{h} x{h} ON x{h}.event_id = en.event_id LEFT JOIN bars b{h} ON b{h}.code = en.code AND b{h}.idx = x{h}.x" for h in horizons)
    return f"""
{name}_f AS (SELECT code, min(idx) AS f FROM bars GROUP BY code),
{name}_s AS (SELECT ev.event_id, ev.code, {start} AS s FROM ev LEFT JOIN cal ON cal.d = ev.td WHERE td IS NOT NULL),
{name}_e AS (SELECT en.*, CASE WHEN s >= f THEN (SELECT min(h.idx) FROM hits h WHERE h.code = en.code AND h.idx BETWEEN en.s AND en.s + 10 AND NOT h.hit_up) END AS e FROM {name}_s en LEFT JOIN {name}_f USING (code)),
{exits},
{name} AS (SELECT en.event_id, en.code, e AS entry_idx, b0.close AS entry_price, e - s AS entry_shift, e IS NULL AS entry_blocked, {columns} FROM {name}_e en LEFT JOIN bars b0 ON b0.code = en.code AND b0.idx = e {joins})
"""


FILLS, LATE = fills("filled", "cal.i", HORIZONS), fills("late", "cal.i + 1", (10, 20))
SIGNALS = """
s1 AS (SELECT *, eps - lag(eps) OVER w AS unexpected, lag(eps) OVER w AS e1, lag(revenue) OVER w AS r1, lag(net_profit) OVER w AS n1 FROM ev WINDOW w AS (PARTITION BY code ORDER BY report_date)),
s2 AS (SELECT *, CASE WHEN count(unexpected) OVER w >= 2 THEN stddev_samp(unexpected) OVER w END AS deviation, greatest(coalesce(max(abs(unexpected)) OVER (PARTITION BY code), 0), 1) AS most FROM s1 WINDOW w AS (PARTITION BY code ORDER BY report_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
sig AS (SELECT *, CASE WHEN deviation > 1e-10 * most THEN round(unexpected / deviation, 6) END AS sue, (revenue - r1) / nullif(abs(r1), 0) AS revenue_growth, (net_profit - n1) / nullif(abs(n1), 0) AS net_profit_growth, (eps - e1) / nullif(abs(e1), 0) AS eps_growth FROM s2)
"""
ANALYSIS = f"WITH {READINGS}, {HITS}, {FEATURES}, {FILLS}, {SIGNALS}," + """
ana AS (SELECT sig.*, l.prev_close, l.adv20, l.volatility_20d, l.momentum_20d, l.float_mcap, l.log_mcap, l.log_adv20, f.entry_blocked, """ + ", ".join(f"round(f.ret_{h}, 8) AS ret_{h}" for h in HORIZONS) + """
FROM (SELECT * FROM sig WHERE td IS NOT NULL) sig ASOF LEFT JOIN logs l ON l.code = sig.code AND sig.td > l.date JOIN filled f ON f.event_id = sig.event_id)
"""
CROSS = ANALYSIS + """,
q AS (SELECT report_date, quantile_cont(sue, 0.01) AS lo, quantile_cont(sue, 0.99) AS hi, count(sue) AS valid FROM ana GROUP BY report_date),
w AS (SELECT ana.*, CASE WHEN sue IS NOT NULL AND valid >= 20 THEN greatest(least(sue, hi), lo) END AS sw FROM ana JOIN q USING (report_date)),
z AS (SELECT *, avg(sw) OVER p AS m, stddev_samp(sw) OVER p AS sd, avg(sw) OVER (PARTITION BY report_date, industry) AS mi, sw IS NOT NULL AND log_mcap IS NOT NULL AS ok, coalesce(industry, '未知') AS g FROM w WINDOW p AS (PARTITION BY report_date)),
o AS (SELECT *, CASE WHEN ok THEN sw - avg(CASE WHEN ok THEN sw END) OVER gg END AS y, CASE WHEN ok THEN log_mcap - avg(CASE WHEN ok THEN log_mcap END) OVER gg END AS x FROM z WINDOW gg AS (PARTITION BY report_date, g)),
b AS (SELECT *, coalesce(sum(x * y) OVER p / nullif(sum(x * x) OVER p, 0), 0) AS slope FROM o WINDOW p AS (PARTITION BY report_date)),
crs AS (SELECT *, round(sw, 8) AS sue_w, round(CASE WHEN sd > 0 THEN (sw - m) / sd END, 8) AS sue_z, round(CASE WHEN industry IS NOT NULL THEN sw - mi END, 8) AS sue_group, round(y - slope * x, 8) AS sue_neutral FROM b)
"""
LONG = ANALYSIS + """,
long AS (SELECT event_id, report_date, sue, unnest([1, 5, 10, 20, 40, 60]) AS horizon, unnest([ret_1, ret_5, ret_10, ret_20, ret_40, ret_60]) AS ret FROM ana),
pairs AS (SELECT * FROM long WHERE sue IS NOT NULL AND ret IS NOT NULL)
"""
ICS = LONG + """,
ranked AS (SELECT *, rank() OVER (PARTITION BY report_date, horizon ORDER BY sue) + (count(*) OVER (PARTITION BY report_date, horizon, sue) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY report_date, horizon ORDER BY ret) + (count(*) OVER (PARTITION BY report_date, horizon, ret) - 1) / 2.0 AS rb FROM pairs),
ics AS (SELECT report_date, horizon, count(*) AS n, CASE WHEN count(*) >= 20 AND min(sue) < max(sue) AND min(ret) < max(ret) THEN round(corr(ra, rb), 6) END AS rank_ic, CASE WHEN count(*) >= 20 AND min(sue) < max(sue) AND min(ret) < max(ret) THEN round(corr(sue, ret), 6) END AS ic FROM ranked GROUP BY report_date, horizon)
"""
BUCKETS = ANALYSIS + """,
ok AS (SELECT report_date, sue, ret_10 FROM ana WHERE sue IS NOT NULL AND ret_10 IS NOT NULL),
edges AS (SELECT report_date, list_sort(list_distinct(quantile_cont(sue, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM ok GROUP BY report_date HAVING count(*) >= 10),
placed AS (SELECT ok.report_date, 1 + len(list_filter(e[2:len(e) - 1], lambda x: x < sue)) AS bucket, ret_10 FROM ok JOIN edges USING (report_date) WHERE len(e) >= 2),
quant AS (SELECT report_date, CAST(bucket AS INT) AS bucket, count(*) AS n, avg(ret_10) AS mean_ret, median(ret_10) AS median_ret, stddev_samp(ret_10) AS std_ret FROM placed GROUP BY report_date, bucket)
"""
BASE = "'sue', 'ret_20', 0.2::DOUBLE, 1e8, 0.0003::DOUBLE, 0.0005::DOUBLE, 0.0005::DOUBLE, 0.05::DOUBLE, 0.5::DOUBLE"
SIGNAL_NAMES = ("sue", "sue_z", "sue_group", "sue_neutral", "net_profit_growth", "revenue_growth", "eps_growth")
RUNS = [
    ("baseline:baseline", BASE),
    *[(f"aum:1e{e}", BASE.replace("1e8", f"1e{e}")) for e in (7, 8, 9)],
    ("cost:double", BASE.partition("1e8")[0] + "1e8, 0.0006, 0.001, 0.001, 0.1, 1.0"),
    *[(f"horizon:{h}", BASE.replace("ret_20", f"ret_{h}")) for h in HORIZONS],
    *[(f"signal:{x}", BASE.replace("'sue'", f"'{x}'")) for x in SIGNAL_NAMES],
    *[(f"top:{t}", BASE.replace("0.2::", f"{t}::")) for t in (0.1, 0.2, 0.3)],
    *[(f"delay:{h}", BASE.replace("ret_20", f"late_{h}")) for h in (10, 20)],
]
RETURNS = [f"ret_{h}" for h in HORIZONS] + ["late_10", "late_20"]
COHORTS = CROSS + f""", {LATE},
wide AS (SELECT crs.*, round(late.ret_10, 8) AS late_10, round(late.ret_20, 8) AS late_20, year(td) AS yr, (SELECT quantile_cont(log_mcap, [0, 1/3::DOUBLE, 2/3::DOUBLE, 1]) FROM crs) AS es, (SELECT quantile_cont(log_adv20, [0, 1/3::DOUBLE, 2/3::DOUBLE, 1]) FROM crs) AS el FROM crs LEFT JOIN late USING (event_id)),
placed AS (SELECT *, CASE WHEN log_mcap IS NOT NULL THEN 1 + CAST(log_mcap > es[2] AS INT) + CAST(log_mcap > es[3] AS INT) END AS size, CASE WHEN log_adv20 IS NOT NULL THEN 1 + CAST(log_adv20 > el[2] AS INT) + CAST(log_adv20 > el[3] AS INT) END AS liquidity FROM wide),
parted AS (SELECT *, unnest(['baseline', 'year', 'size', 'liquidity']) AS part, unnest([NULL::INT, CAST(yr AS INT), CAST(size AS INT), CAST(liquidity AS INT)]) AS val FROM placed),
subs AS (SELECT part, val FROM parted WHERE val IS NOT NULL GROUP BY ALL HAVING count(*) >= 20),
scen(scenario, part, val, signal, outcome, top, aum, com, tax, hs, sl, im) AS (
""" + " UNION ALL ".join(f"SELECT '{name}', 'baseline', NULL, {terms}" for name, terms in RUNS) + f""" UNION ALL SELECT part || ':' || val, part, val, {BASE} FROM subs),
runs AS (SELECT scen.*, event_id, strftime(td, '%Y-%m') AS cohort, adv20 AS adv, volatility_20d AS vol, CASE signal """ + " ".join(f"WHEN '{x}' THEN {x}" for x in SIGNAL_NAMES) + " END AS score, CASE outcome " + " ".join(f"WHEN '{x}' THEN {x}" for x in RETURNS) + """ END AS ret FROM parted JOIN scen ON scen.part = parted.part AND scen.val IS NOT DISTINCT FROM parted.val WHERE NOT entry_blocked),
usable AS (SELECT * FROM runs WHERE score IS NOT NULL AND ret IS NOT NULL),
sized AS (SELECT *, count(*) OVER c AS n, avg(ret) OVER c AS benchmark, row_number() OVER (PARTITION BY scenario, cohort ORDER BY score DESC, event_id) AS pos FROM usable WINDOW c AS (PARTITION BY scenario, cohort)),
picked AS (SELECT *, greatest(1, ceil(top * n)) AS k FROM sized WHERE n >= 5 AND pos <= greatest(1, ceil(top * n))),
filledin AS (SELECT *, coalesce(adv, median(adv) OVER c) AS a, coalesce(vol, median(vol) OVER c, 0) AS v FROM picked WINDOW c AS (PARTITION BY scenario, cohort)),
parts AS (SELECT *, CASE WHEN a > 0 THEN least(aum / k / a, 0.1) END AS share FROM filledin),
sums AS (SELECT scenario, cohort, any_value(n) AS n, CAST(any_value(k) AS BIGINT) AS k, avg(ret) AS gross, any_value(benchmark) AS benchmark, 2 * any_value(com) AS commission, any_value(tax) AS tax, 2 * coalesce(avg(hs + sl * share), 0) AS slippage, 2 * coalesce(avg(im * v * sqrt(share)), 0) AS impact, quantile_cont(0.1::DOUBLE * a * k, 0.05) AS capacity, count(*) - count(adv) AS adv_missing FROM parts GROUP BY scenario, cohort),
coh AS (SELECT *, commission + tax + slippage + impact AS cost, gross - benchmark AS active, gross - (commission + tax + slippage + impact) AS net FROM sums)
"""
REGRESSIONS = ANALYSIS + """,
spc AS (SELECT *, unnest(['numeric', 'numeric+industry']) AS spec FROM ana),
grp AS (SELECT *, CASE spec WHEN 'numeric' THEN '' ELSE coalesce(industry, '未知') END AS g FROM spc),
dum AS (SELECT report_date, spec, count(DISTINCT g) - 1 AS dummies FROM grp GROUP BY ALL),
full_cases AS (SELECT * FROM grp WHERE sue IS NOT NULL AND log_mcap IS NOT NULL AND momentum_20d IS NOT NULL AND volatility_20d IS NOT NULL AND ret_10 IS NOT NULL),
c0 AS (SELECT report_date, spec, ret_10 - avg(ret_10) OVER w AS y, sue - avg(sue) OVER w AS s, log_mcap - avg(log_mcap) OVER w AS a, momentum_20d - avg(momentum_20d) OVER w AS c, volatility_20d - avg(volatility_20d) OVER w AS d FROM full_cases WINDOW w AS (PARTITION BY report_date, spec, g)),
c1 AS (SELECT * REPLACE (y - a * sum(y * a) OVER p / sum(a * a) OVER p AS y, s - a * sum(s * a) OVER p / sum(a * a) OVER p AS s, c - a * sum(c * a) OVER p / sum(a * a) OVER p AS c, d - a * sum(d * a) OVER p / sum(a * a) OVER p AS d) FROM c0 WINDOW p AS (PARTITION BY report_date, spec)),
c2 AS (SELECT * REPLACE (y - c * sum(y * c) OVER p / sum(c * c) OVER p AS y, s - c * sum(s * c) OVER p / sum(c * c) OVER p AS s, d - c * sum(d * c) OVER p / sum(c * c) OVER p AS d) FROM c1 WINDOW p AS (PARTITION BY report_date, spec)),
c3 AS (SELECT * REPLACE (y - d * sum(y * d) OVER p / sum(d * d) OVER p AS y, s - d * sum(s * d) OVER p / sum(d * d) OVER p AS s) FROM c2 WINDOW p AS (PARTITION BY report_date, spec)),
e4 AS (SELECT report_date, spec, count(*) AS n, sum(s * y) / sum(s * s) AS b, sum(s * s) AS ss, sum(y * y) - sum(s * y) ** 2 / sum(s * s) AS ssr FROM c3 GROUP BY ALL),
fit AS (SELECT e4.*, n - 5 - dummies AS dof, b / sqrt(ssr / (n - 5 - dummies) / ss) AS t FROM e4 JOIN dum USING (report_date, spec) WHERE n >= 4 + dummies + 2)
"""
NAMES = rf"""
said AS (SELECT DISTINCT "股票代码" AS code, audit_ts AS seen, upper(regexp_replace(translate("当前简称", '{WIDE}', '{PLAIN}'), '[\s\p{{Z}}]+', '', 'g')) AS v FROM sample_audit WHERE "当前简称" IS NOT NULL),
steps AS (SELECT *, lag(v) OVER (PARTITION BY code ORDER BY seen) AS p FROM said WHERE v <> ''),
chg AS (SELECT code, CAST(seen AS DATE) AS cd, arg_min(p, seen) AS b, arg_max(v, seen) AS a FROM steps WHERE p <> v GROUP BY code, CAST(seen AS DATE)),
tl AS (SELECT code, DATE '1900-01-01' AS vf, arg_min(b, cd) AS nm FROM chg GROUP BY code UNION ALL SELECT code, cd, a FROM chg)
"""
HELDW = ANALYSIS + """,
base AS (SELECT *, strftime(td, '%Y-%m') AS month FROM ana WHERE NOT entry_blocked),
able AS (SELECT *, count(*) OVER (PARTITION BY month) AS n, row_number() OVER (PARTITION BY month ORDER BY sue DESC, event_id) AS pos FROM base WHERE sue IS NOT NULL),
sel AS (SELECT *, 1 / greatest(1, ceil(0.2::DOUBLE * n)) AS weight FROM able WHERE pos <= greatest(1, ceil(0.2::DOUBLE * n)))
"""


TITLES = f"""WITH {READINGS}, t AS (SELECT DISTINCT scan_id, code, CAST(scan_ts AS DATE) AS d, correction_titles AS title FROM correction_scan WHERE correction_titles <> ''),
lb AS (SELECT *, CASE strftime(report_date, '%m-%d') WHEN '03-31' THEN '第一季度报告' WHEN '06-30' THEN '半年度报告' WHEN '09-30' THEN '第三季度报告' WHEN '12-31' THEN '年度报告' ELSE '报告' END AS label FROM ev WHERE disc IS NOT NULL),
h AS (SELECT lb.event_id, label, title, d, coalesce(regexp_matches(title, '更正|修订|勘误|补充公告'), false) AS hit FROM lb LEFT JOIN t ON t.code = lb.code AND t.d > disc AND t.d <= disc + 120),
m AS (SELECT event_id, count(title) AS announcements, count_if(hit) AS corrections, count_if(hit AND contains(title, label)) AS report_corrections, coalesce(string_agg(title, ' | ' ORDER BY d, title) FILTER (hit), '') AS titles FROM h GROUP BY event_id)
"""


def r(names: str, digits: int = 6) -> str:
    """round(x, digits) AS x for each of the names."""
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names.split())


TABLES = CROSS + """,
gr AS (SELECT *, unnest(['report_date', 'entry_month']) AS group_type, unnest([CAST(report_date AS VARCHAR), strftime(td, '%Y-%m')]) AS "group" FROM crs),
sg AS (SELECT *, unnest(['sue', 'sue_z', 'sue_group', 'sue_neutral', 'net_profit_growth', 'revenue_growth', 'eps_growth']) AS signal, unnest([sue, sue_z, sue_group, sue_neutral, net_profit_growth, revenue_growth, eps_growth]) AS v FROM gr),
lg AS (SELECT signal, group_type, "group", v, unnest([1, 5, 10, 20, 40, 60]) AS horizon, unnest([ret_1, ret_5, ret_10, ret_20, ret_40, ret_60]) AS ret FROM sg),
pr AS (SELECT *, rank() OVER (PARTITION BY signal, horizon, group_type, "group" ORDER BY v) + (count(*) OVER (PARTITION BY signal, horizon, group_type, "group", v) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY signal, horizon, group_type, "group" ORDER BY ret) + (count(*) OVER (PARTITION BY signal, horizon, group_type, "group", ret) - 1) / 2.0 AS rb FROM lg WHERE v IS NOT NULL AND ret IS NOT NULL),
tb AS (SELECT signal, horizon, group_type, "group", count(*) AS n_obs, CASE WHEN count(*) >= 20 AND min(v) < max(v) AND min(ret) < max(ret) THEN round(corr(ra, rb), 6) END AS ic FROM pr GROUP BY ALL)
"""
FLAGS = rf"""WITH {READINGS}, {NAMES}, e AS (SELECT event_id, code, disc, nullif(upper(regexp_replace(translate(name, '{WIDE}', '{PLAIN}'), '[\s\p{{Z}}]+', '', 'g')), '') AS cur FROM ev),
m AS (SELECT e.*, tl.nm FROM e ASOF LEFT JOIN tl ON tl.code = e.code AND e.disc >= tl.vf),
fl AS (SELECT event_id, nm AS name_then, CASE WHEN nm IS NOT NULL THEN 'history' WHEN cur IS NOT NULL THEN 'current' ELSE 'unknown' END AS flag_basis, coalesce(nm, cur) LIKE 'ST%' OR coalesce(nm, cur) LIKE '*ST%' AS is_flagged FROM m)
"""


def water(source: str, name: str, item: str, share: str, cap: float) -> str:
    """CTEs that end in ``name``: the factor f per month with sum(least(cap, f * share)) = 1, tried at each number of capped items."""
    return f"""{name}_o AS (SELECT month, {item} AS it, {share} AS s, row_number() OVER w - 1 AS j, coalesce(sum({share}) OVER (PARTITION BY month ORDER BY {share} DESC, {item} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM {source} WHERE {share} > 0 WINDOW w AS (PARTITION BY month ORDER BY {share} DESC, {item})),
{name}_t AS (SELECT *, (1 - j * {cap}::DOUBLE) / nullif(1 - p, 0) AS f FROM {name}_o),
{name} AS (SELECT month, coalesce(arg_min(f, j) FILTER (f * s <= {cap}::DOUBLE + 1e-12), CASE WHEN 1 - sum(s) > 1e-12 THEN greatest(1 - count(*) * {cap}::DOUBLE, 0) / (1 - sum(s)) END) AS f FROM {name}_t GROUP BY month)"""


CAPPED = HELDW + """,
a0 AS (SELECT month, event_id, industry, 1.0::DOUBLE / count(*) OVER (PARTITION BY month) AS even, least(coalesce(s.weight, 0), coalesce(adv20 / 1e8, coalesce(s.weight, 0))) AS w FROM base LEFT JOIN (SELECT event_id, weight FROM sel) s USING (event_id)),
a1 AS (SELECT * REPLACE (coalesce(w / nullif(sum(w) OVER (PARTITION BY month), 0), 0) AS w) FROM a0),
gs AS (SELECT month, industry, sum(w) AS s FROM a1 WHERE industry IS NOT NULL GROUP BY ALL),
""" + water("gs", "gf", "industry", "s", 0.4) + """,
a2 AS (SELECT month, event_id, even, CASE WHEN industry IS NULL THEN w * coalesce(f, 1) WHEN s > 0 THEN w * coalesce(least(0.4::DOUBLE, f * s), 0.4::DOUBLE) / s ELSE w END AS w FROM a1 LEFT JOIN gs USING (month, industry) LEFT JOIN gf USING (month)),
a3 AS (SELECT * REPLACE (coalesce(w / nullif(sum(w) OVER (PARTITION BY month), 0), 0) AS w) FROM a2),
""" + water("a3", "nf", "event_id", "w", 0.15) + """,
a4 AS (SELECT month, event_id, even, CASE WHEN w > 0 THEN coalesce(least(0.15::DOUBLE, f * w), 0.15::DOUBLE) ELSE 0 END AS w FROM a3 LEFT JOIN nf USING (month)),
a5 AS (SELECT * REPLACE (coalesce(w / nullif(sum(w) OVER (PARTITION BY month), 0), 0) AS w) FROM a4),
a6 AS (SELECT *, sum(abs(w - even)) OVER (PARTITION BY month) / 2 AS moved, sum(w) OVER (PARTITION BY month) AS held FROM a5)
SELECT month, event_id, round(CASE WHEN held > 0 THEN even + (w - even) * CASE WHEN moved > 0.6::DOUBLE THEN 0.6::DOUBLE / moved ELSE 1 END ELSE 0 END, 6) AS weight FROM a6"""
SQL = {
    "daily_bars": f"WITH {READINGS} SELECT code, date, close, amount, volume, turnover FROM bars",
    "calendar_shift": f"""WITH {READINGS}, p AS (SELECT event_id, disc, (SELECT min(i) FROM cal WHERE d >= disc) AS ge, (SELECT max(i) FROM cal WHERE d <= disc) AS le FROM ev)
SELECT event_id, disc AS actual_disclosure_date, a.d AS plus3, b.d AS plus0, c.d AS minus2, CASE WHEN disc IS NOT NULL THEN coalesce(ge = le, false) END AS is_session FROM p LEFT JOIN cal a ON a.i = ge + 3 LEFT JOIN cal b ON b.i = ge LEFT JOIN cal c ON c.i = le - 2""",
    "tradable_dates": f"""WITH {READINGS}, p AS (SELECT event_id, disc, (SELECT min(i) FROM cal WHERE d >= disc) AS ge, (SELECT min(i) FROM cal WHERE d > disc) AS gt FROM ev)
SELECT event_id, disc AS actual_disclosure_date, a.d AS lag0, b.d AS lag1, c.d AS lag2 FROM p LEFT JOIN cal a ON a.i = ge LEFT JOIN cal b ON b.i = gt LEFT JOIN cal c ON c.i = gt + 1""",
    "session_counts": f"WITH {READINGS} SELECT event_id, CAST((SELECT count(*) FROM cal WHERE d BETWEEN report_date AND disc) AS INT) AS both, CAST((SELECT count(*) FROM cal WHERE d >= report_date AND d < disc) AS INT) AS left, CAST((SELECT count(*) FROM cal WHERE d > report_date AND d <= disc) AS INT) AS right, CAST((SELECT count(*) FROM cal WHERE d > report_date AND d < disc) AS INT) AS neither FROM ev",
    "sessions_after": f"WITH {READINGS} SELECT event_id, d AS session_date FROM ev JOIN cal ON d > disc AND d <= disc + 10",
    "panel_audit": f"WITH {READINGS} SELECT count(*) AS events, count(DISTINCT code) AS codes, count(DISTINCT report_date) AS periods, min(report_date) AS first_report, max(td) AS last_entry, count_if(report_date > disc) AS early, count_if(td <= disc) AS late FROM ev",
    "coverage_audit": """WITH a AS (SELECT DISTINCT code, report_date, 1 AS x FROM event_panel), b AS (SELECT DISTINCT "股票代码" AS code, "报告期" AS report_date, 1 AS y FROM sample_audit WHERE "报告期" IS NOT NULL)
SELECT count(x) AS events, count(y) AS audited, count_if(x IS NOT NULL AND y IS NOT NULL) AS matched, count_if(y IS NULL) AS events_only, count_if(x IS NULL) AS audited_only FROM a FULL JOIN b USING (code, report_date)""",
    "names_then": rf"""WITH {READINGS}, {NAMES}, e AS (SELECT event_id, code, disc, nullif(upper(regexp_replace(translate(name, '{WIDE}', '{PLAIN}'), '[\s\p{{Z}}]+', '', 'g')), '') AS cur FROM ev),
m AS (SELECT e.*, tl.nm FROM e ASOF LEFT JOIN tl ON tl.code = e.code AND e.disc >= tl.vf)
SELECT event_id, nm AS name_then, CASE WHEN nm IS NOT NULL THEN 'history' WHEN cur IS NOT NULL THEN 'current' ELSE 'unknown' END AS flag_basis, coalesce(nm, cur) LIKE 'ST%' OR coalesce(nm, cur) LIKE '*ST%' AS is_flagged FROM m""",
    "listed_events": f"""WITH {READINGS}, life AS (SELECT code, min(date) AS a, max(date) AS z FROM bars GROUP BY code), l AS (SELECT code, a, CASE WHEN z < (SELECT max(d) FROM cal) - 40 THEN z END AS z FROM life)
SELECT event_id, coalesce(z <= disc, false) AS is_delisted FROM ev JOIN l USING (code) WHERE a <= disc AND (z IS NULL OR z > disc)""",
    "survivorship": f"""WITH {READINGS}, life AS (SELECT code, max(date) AS z FROM bars GROUP BY code HAVING max(date) < (SELECT max(d) FROM cal) - 40)
SELECT count(*) AS events, count(DISTINCT code) AS codes, count(DISTINCT CASE WHEN z IS NOT NULL THEN code END) AS codes_delisted, count(z) AS events_delisted, round(count(DISTINCT CASE WHEN z IS NOT NULL THEN code END) / count(DISTINCT code), 6) AS share, CASE WHEN count(z) = 0 THEN '样本内无后来退市公司: 数据源疑似剔除退市股, 存在幸存者偏差' ELSE '样本包含后来退市公司' END AS finding FROM ev LEFT JOIN life USING (code)""",
    "limit_hits": f"WITH {READINGS}, {HITS} SELECT code, date, close, round(up, 6) AS up_price, round(down, 6) AS down_price, hit_up, hit_down FROM hits WHERE hit_up OR hit_down",
    "flagged_limit_hits": f"""WITH {READINGS}, fl AS (SELECT DISTINCT "股票代码" AS code FROM sample_audit WHERE "当时ST"), {HITS.replace("ELSE 0.1::DOUBLE END", "WHEN code IN (SELECT code FROM fl) THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END")}
SELECT code, date, close, round(up, 6) AS up_price, round(down, 6) AS down_price, hit_up, hit_down FROM hits WHERE hit_up OR hit_down""",
    "suspended_sessions": f"WITH {READINGS}, span AS (SELECT code, min(idx) AS a, max(idx) AS z FROM bars GROUP BY code) SELECT span.code, cal.d AS date FROM span JOIN cal ON cal.i BETWEEN a AND z ANTI JOIN bars ON bars.code = span.code AND bars.idx = cal.i",
    "features": f"WITH {READINGS}, {FEATURES} SELECT code, date, {r('adv20 float_mcap', 4)}, {r('prev_close volatility_20d momentum_20d log_mcap log_adv20', 8)} FROM logs",
    "features_before": f"WITH {READINGS}, {FEATURES} SELECT event_id, e.code, td AS tradable_date, {r('adv20 float_mcap', 4)}, {r('prev_close volatility_20d momentum_20d log_mcap log_adv20', 8)}, l.date AS bar_date FROM (SELECT * FROM ev WHERE td IS NOT NULL) e ASOF LEFT JOIN logs l ON l.code = e.code AND e.td > l.date",
    "adjusted_closes": f"""WITH {READINGS}, act AS (SELECT DISTINCT lpad(regexp_replace(translate(code, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g'), 6, '0') AS code, date AS ex FROM feed WHERE corporate_action),
k AS (SELECT a.code, ex, (b.close - 0.1::DOUBLE) / 1.05::DOUBLE / b.close AS k FROM act a ASOF JOIN bars b ON b.code = a.code AND a.ex > b.date),
f AS (SELECT b.code, b.date, any_value(b.close) AS c, coalesce(product(k) FILTER (ex > b.date), 1) AS q, coalesce(product(k) FILTER (ex <= b.date), 1) AS h FROM bars b LEFT JOIN (SELECT * FROM k WHERE k > 0) k ON k.code = b.code GROUP BY b.code, b.date)
SELECT code, date, round(c * q, 4) AS qfq, round(c / h, 4) AS hfq FROM f""",
    "filled_events": f"WITH {READINGS}, {HITS}, {FILLS} SELECT event_id, entry_idx, entry_price, entry_shift, entry_blocked, " + ", ".join(f"exit_idx_{h}, exit_blocked_{h}, round(ret_{h}, 6) AS ret_{h}" for h in HORIZONS) + " FROM filled",
    "filled_audit": f"WITH {READINGS}, {HITS}, {FILLS} SELECT count(*) AS events, round(avg(CAST(entry_blocked AS INT)), 6) AS blocked_rate, round(avg(CAST(coalesce(entry_shift > 0, false) AS INT)), 6) AS deferred_rate, round(avg(entry_shift), 6) AS mean_shift, " + ", ".join(f"round(avg(CAST(ret_{h} IS NOT NULL AS INT)), 6) AS coverage_{h}, round(avg(CAST(exit_blocked_{h} AS INT)), 6) AS exit_blocked_rate_{h}, round(avg(ret_{h} - (p{h}.close / p0.close - 1)), 6) AS shift_impact_{h}" for h in HORIZONS) + " FROM filled JOIN ev USING (event_id, code) LEFT JOIN cal ON cal.d = td LEFT JOIN bars p0 ON p0.code = filled.code AND p0.idx = cal.i " + " ".join(f"LEFT JOIN bars p{h} ON p{h}.code = filled.code AND p{h}.idx = cal.i + {h}" for h in HORIZONS),
    "delayed_entries": f"WITH {READINGS}, {HITS}, {LATE} SELECT event_id, entry_idx, " + ", ".join(f"exit_idx_{h}, round(ret_{h}, 6) AS ret_{h}" for h in (10, 20)) + " FROM late",
    "forward_rates": f"WITH {READINGS} SELECT event_id, " + ", ".join(f"round(b{h}.close / b0.close - 1, 6) AS fwd_ret_{h}" for h in HORIZONS) + " FROM ev LEFT JOIN cal ON cal.d = td LEFT JOIN bars b0 ON b0.code = ev.code AND b0.idx = cal.i " + " ".join(f"LEFT JOIN bars b{h} ON b{h}.code = ev.code AND b{h}.idx = cal.i + {h}" for h in HORIZONS) + " WHERE td IS NOT NULL",
    "surprises": f"""WITH {READINGS}, {SIGNALS}, old AS (SELECT code, last_day(report_date + INTERVAL 12 MONTH) AS q, max(revenue) AS y FROM ev GROUP BY ALL)
SELECT event_id, round(unexpected, 6) AS unexpected, round(deviation, 6) AS deviation, sue, round(revenue_growth, 6) AS revenue_growth, round(net_profit_growth, 6) AS net_profit_growth, round(unexpected, 6) AS eps_change, round(revenue_growth, 6) AS revenue_surprise, round(y, 6) AS revenue_year_before FROM sig LEFT JOIN old ON old.code = sig.code AND old.q = report_date""",
    "signal_coverage": f"WITH {READINGS}, {SIGNALS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS present, round(count({c}) / count(*), 4) AS share, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS deviation FROM sig" for c in ("sue", "revenue_growth", "net_profit_growth")),
    "eps_check": f"""WITH {READINGS}, a AS (SELECT "股票代码" AS code, "报告期" AS report_date, arg_max("每股收益", "序号") AS x FROM sample_audit WHERE "每股收益" IS NOT NULL GROUP BY ALL), j AS (SELECT eps, abs(eps - x) AS d FROM ev JOIN a USING (code, report_date) WHERE eps IS NOT NULL)
SELECT count(*) AS compared, count_if(NOT d <= 0.02::DOUBLE * greatest(abs(eps), 1)) AS mismatches, round(avg(CAST(d <= 0.02::DOUBLE * greatest(abs(eps), 1) AS INT)), 6) AS match_rate, round(avg(d), 6) AS mean_difference, round(max(d), 6) AS max_difference FROM j""",
    "cross_section": CROSS + "SELECT event_id, sue_w, sue_z, sue_group, sue_neutral FROM crs",
    "recent_neutral": ANALYSIS + """, rc AS (SELECT *, coalesce(industry, '未知') AS g, count(sue) OVER () AS valid FROM ana WHERE td > (SELECT max(td) FROM ana) - 35),
w AS (SELECT *, CASE WHEN sue IS NOT NULL AND valid >= 20 THEN greatest(least(sue, (SELECT quantile_cont(sue, 0.99) FROM rc)), (SELECT quantile_cont(sue, 0.01) FROM rc)) END AS sw FROM rc),
o AS (SELECT *, CASE WHEN sw IS NOT NULL AND log_mcap IS NOT NULL THEN sw - avg(CASE WHEN log_mcap IS NOT NULL THEN sw END) OVER gg END AS y, CASE WHEN sw IS NOT NULL AND log_mcap IS NOT NULL THEN log_mcap - avg(CASE WHEN sw IS NOT NULL THEN log_mcap END) OVER gg END AS x FROM w WINDOW gg AS (PARTITION BY g))
SELECT event_id, round(sw, 8) AS sue_w, round(y - coalesce((SELECT sum(x * y) / nullif(sum(x * x), 0) FROM o), 0) * x, 8) AS sue_neutral FROM o""",
    "ic_by_period": ICS + "SELECT * FROM ics",
    "ic_statistics": ICS + """, st AS (SELECT horizon, count(rank_ic) AS periods, avg(rank_ic) AS m, stddev_samp(rank_ic) AS s, avg(CAST(rank_ic > 0 AS INT)) AS pr, min(rank_ic) AS a, max(rank_ic) AS z FROM ics WHERE rank_ic IS NOT NULL GROUP BY horizon),
u AS (SELECT ics.horizon, report_date, rank_ic - m AS u, periods FROM ics JOIN st USING (horizon) WHERE rank_ic IS NOT NULL),
l AS (SELECT *, lag(u) OVER w AS u1, lag(u, 2) OVER w AS u2, least(2, periods - 1) AS lg FROM u WINDOW w AS (PARTITION BY horizon ORDER BY report_date)),
v AS (SELECT horizon, sum(u * u + CASE WHEN lg >= 1 THEN 2 * (1 - 1.0::DOUBLE / (lg + 1)) * coalesce(u * u1, 0) ELSE 0 END + CASE WHEN lg >= 2 THEN 2 * (1 - 2.0::DOUBLE / (lg + 1)) * coalesce(u * u2, 0) ELSE 0 END) / any_value(periods) AS lrv FROM l GROUP BY horizon)
SELECT horizon, periods, round(m, 8) AS mean_ic, round(s, 8) AS std_ic, round(pr, 8) AS positive_rate, round(a, 8) AS min_ic, round(z, 8) AS max_ic, round(CASE WHEN periods >= 3 AND s > 0 THEN m / s END, 8) AS icir, round(CASE WHEN periods >= 3 AND s > 0 THEN m / s * sqrt(periods) END, 8) AS t_stat, round(CASE WHEN periods >= 3 AND lrv > 0 THEN m / sqrt(lrv / periods) END, 8) AS nw_t FROM st JOIN v USING (horizon)""",
    "decay": LONG + """, rk AS (SELECT *, rank() OVER (PARTITION BY horizon ORDER BY sue) + (count(*) OVER (PARTITION BY horizon, sue) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY horizon ORDER BY ret) + (count(*) OVER (PARTITION BY horizon, ret) - 1) / 2.0 AS rb,
rank() OVER (PARTITION BY horizon, report_date ORDER BY sue) + (count(*) OVER (PARTITION BY horizon, report_date, sue) - 1) / 2.0 AS da, rank() OVER (PARTITION BY horizon, report_date ORDER BY ret) + (count(*) OVER (PARTITION BY horizon, report_date, ret) - 1) / 2.0 AS db FROM pairs),
dc AS (SELECT horizon, CASE WHEN count(*) >= 2 AND min(sue) < max(sue) AND min(ret) < max(ret) THEN corr(da, db) END AS c FROM rk GROUP BY horizon, report_date), dm AS (SELECT horizon, avg(c) AS mean_ic FROM dc GROUP BY horizon)
SELECT horizon, round(corr(ra, rb), 6) AS ic, round(any_value(mean_ic), 6) AS mean_ic FROM rk JOIN dm USING (horizon) GROUP BY horizon""",
    "quantile_periods": BUCKETS + "SELECT report_date, bucket, n, round(mean_ret, 6) AS mean_ret, round(median_ret, 6) AS median_ret, round(std_ret, 6) AS std_ret FROM quant",
    "quantile_summary": BUCKETS + """, ro AS (SELECT bucket, avg(mean_ret) AS m, count(*) AS periods, CAST(sum(n) AS BIGINT) AS n FROM quant GROUP BY bucket), st AS (SELECT *, m - lag(m) OVER (ORDER BY bucket) AS d FROM ro)
SELECT bucket, round(m, 6) AS mean_ret, periods, n, (SELECT count(*) >= 3 AND coalesce(bool_and(d >= -1e-12), true) FROM st) AS monotonic FROM ro""",
    "regressions": REGRESSIONS + "SELECT report_date, spec, round(b, 6) AS coef, round(t, 6) AS t_stat, n FROM fit",
    # |t| beyond the 97.5 percent point of Student's distribution, by its series in 1 / dof
    "regression_means": REGRESSIONS + """, z AS (SELECT *, 1.959963984540054::DOUBLE AS q FROM fit),
c AS (SELECT *, q + (q**3 + q) / (4 * dof) + (5 * q**5 + 16 * q**3 + 3 * q) / (96 * dof**2) + (3 * q**7 + 19 * q**5 + 17 * q**3 - 15 * q) / (384 * dof**3) AS most FROM z)
SELECT spec, count(*) AS periods, round(avg(b), 6) AS mean_coef, round(avg(t), 6) AS mean_t, round(avg(CAST(t > 0 AS INT)), 6) AS share_positive_t, round(avg(CAST(abs(t) > most AS INT)), 6) AS share_significant FROM c GROUP BY spec""",
    "regression_single": ANALYSIS + """, ok AS (SELECT report_date, sue AS x, ret_10 AS y FROM ana WHERE sue IS NOT NULL AND ret_10 IS NOT NULL),
g AS (SELECT report_date, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM ok GROUP BY report_date HAVING count(*) >= 3)
SELECT report_date, round(b, 6) AS coef, round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 6) AS t_stat, n FROM g""",
    "cohort_results": COHORTS + f"SELECT scenario, cohort, n, k, {r('gross benchmark active commission tax slippage impact cost net', 12)}, round(capacity, 4) AS capacity, adv_missing FROM coh",
    "scenario_metrics": COHORTS + """, cum AS (SELECT *, exp(sum(CASE WHEN gross > -1 THEN ln(1 + gross) END) OVER w) * CAST(min(1 + gross) OVER w > 0 AS INT) AS ng, exp(sum(CASE WHEN net > -1 THEN ln(1 + net) END) OVER w) * CAST(min(1 + net) OVER w > 0 AS INT) AS nn FROM coh WINDOW w AS (PARTITION BY scenario ORDER BY cohort)),
dd AS (SELECT *, ng / nullif(max(ng) OVER w, 0) - 1 AS dg, nn / nullif(max(nn) OVER w, 0) - 1 AS dn FROM cum WINDOW w AS (PARTITION BY scenario ORDER BY cohort))
SELECT scenario, count(*) AS cohorts, CAST(sum(n) AS BIGINT) AS events, round(avg(k), 8) AS mean_names, """ + ", ".join(f"round(CASE WHEN min({c}) > -1 THEN exp(sum(CASE WHEN {c} > -1 THEN ln(1 + {c}) END) * 12 / count(*)) - 1 END, 8) AS {c}_annual" for c in ("gross", "net", "benchmark")) + """,
round(avg(gross) / nullif(stddev_samp(gross), 0) * sqrt(12), 8) AS gross_sharpe, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(12), 8) AS net_sharpe, round(avg(benchmark) / nullif(stddev_samp(benchmark), 0) * sqrt(12), 8) AS benchmark_sharpe,
round(stddev_samp(active) * sqrt(12), 8) AS tracking_error, round(avg(active) * 12 / nullif(stddev_samp(active) * sqrt(12), 0), 8) AS information_ratio, round(avg(net - benchmark) * 12 / nullif(stddev_samp(net - benchmark) * sqrt(12), 0), 8) AS net_information_ratio,
round(avg(CAST(active > 0 AS INT)), 8) AS hit_rate, round(avg(CAST(net > 0 AS INT)), 8) AS net_hit_rate, round(avg(CAST(gross > 0 AS INT)), 8) AS gross_hit_rate, round(avg(cost), 8) AS mean_cost, round(avg(cost) * 12, 8) AS cost_drag_annual, 2.0::DOUBLE AS mean_turnover,
round(median(capacity), 4) AS capacity_median, round(sum(adv_missing) / greatest(sum(k), 1), 8) AS adv_missing_rate, round(min(dg), 8) AS gross_drawdown, round(min(dn), 8) AS net_drawdown FROM dd GROUP BY scenario""",
    "selected_weights": HELDW + "SELECT month, event_id, round(weight, 6) AS weight FROM sel",
    "monthly_turnover": HELDW + """, mo AS (SELECT month, lead(month) OVER (ORDER BY month) AS nx FROM (SELECT DISTINCT month FROM base)), hw AS (SELECT month, code, sum(weight) AS w FROM sel GROUP BY ALL),
mv AS (SELECT month, code, w FROM hw UNION ALL SELECT nx, code, -w FROM hw JOIN mo USING (month) WHERE nx IS NOT NULL UNION ALL SELECT month, NULL, 0 FROM mo), nt AS (SELECT month, code, sum(w) AS w FROM mv GROUP BY ALL)
SELECT month, round(sum(abs(w)) / 2, 6) AS turnover FROM nt GROUP BY month""",
    "monthly_capacity": HELDW + "SELECT month, round(quantile_cont(0.1::DOUBLE * adv20 / weight, 0.05), 0) AS capacity FROM sel WHERE adv20 IS NOT NULL GROUP BY month",
    "monthly_active": HELDW + ", ev2 AS (SELECT month, event_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY month) AS w FROM base) SELECT month, event_id, round(coalesce(s.weight, 0) - ev2.w, 6) AS active FROM ev2 LEFT JOIN (SELECT event_id, weight FROM sel) s USING (event_id)",
    "inverse_volatility": HELDW + """, i AS (SELECT month, event_id, CASE WHEN volatility_20d > 0 THEN 1 / volatility_20d ELSE 0 END AS i FROM sel), c AS (SELECT month, event_id, least(coalesce(i / nullif(sum(i) OVER (PARTITION BY month), 0), 0), 0.2::DOUBLE) AS c FROM i)
SELECT month, event_id, round(coalesce(c / nullif(sum(c) OVER (PARTITION BY month), 0), 0), 6) AS weight FROM c""",
    "order_requests": f"""WITH {READINGS}, {HITS}, {FEATURES}, span AS (SELECT code, min(idx) AS a, max(idx) AS z FROM bars GROUP BY code),
off AS (SELECT span.code, cal.d AS date FROM span JOIN cal ON cal.i BETWEEN a AND z ANTI JOIN bars ON bars.code = span.code AND bars.idx = cal.i),
q AS (SELECT event_id, code, td AS date, unnest(['buy', 'sell']) AS side FROM ev WHERE td IS NOT NULL),
w AS (SELECT q.event_id, q.side, CASE WHEN off.code IS NOT NULL THEN 'suspended' WHEN side = 'buy' AND hit_up THEN 'limit up' WHEN side = 'sell' AND hit_down THEN 'limit down' WHEN coalesce(adv20 < 1e6, true) THEN 'thin' END AS reason
FROM q LEFT JOIN off ON off.code = q.code AND off.date = q.date LEFT JOIN hits ON hits.code = q.code AND hits.date = q.date LEFT JOIN logs ON logs.code = q.code AND logs.date = q.date)
SELECT event_id, side, reason IS NULL AS tradable, reason FROM w""",
    "trading_costs": """WITH l AS (SELECT DISTINCT liq_id, adv20, volatility_20d AS vol FROM liquidity), p AS (SELECT *, CASE WHEN adv20 > 0 THEN least(1e6 / adv20, 0.1::DOUBLE) END AS part FROM l),
c AS (SELECT *, 0.0005::DOUBLE + 0.05::DOUBLE * part AS slip, 0.5::DOUBLE * vol * sqrt(part) AS imp FROM p)
SELECT liq_id, round(slip, 4) AS slippage, round(imp, 4) AS impact, round(CASE WHEN adv20 > 0 THEN adv20 * 0.1::DOUBLE ELSE 0 END, 4) AS cap, round(2e6 * 0.0003::DOUBLE + 1e6 * 0.0005::DOUBLE + 2e6 * (slip + imp), 4) AS cost FROM c""",
    "title_corrections": TITLES + "SELECT event_id, announcements, corrections, report_corrections, report_corrections > 0 AS report_corrected, titles FROM m",
    "correction_counts": TITLES + "SELECT count(*) AS events, count_if(announcements > 0) AS with_announcements, count_if(report_corrections > 0) AS corrected, round(avg(CAST(report_corrections > 0 AS INT)), 6) AS corrected_rate, CAST(sum(announcements) AS BIGINT) AS announcements FROM m",
    "code_sets": f"""WITH {READINGS}, a AS (SELECT DISTINCT code FROM canon), b AS (SELECT DISTINCT code FROM ev)
SELECT code, 'union' AS part FROM (SELECT code FROM a UNION SELECT code FROM b) UNION ALL SELECT code, 'both' FROM (SELECT code FROM a INTERSECT SELECT code FROM b) UNION ALL SELECT code, 'prices_only' FROM (SELECT code FROM a EXCEPT SELECT code FROM b) UNION ALL SELECT code, 'events_only' FROM (SELECT code FROM b EXCEPT SELECT code FROM a)""",
    "audit_sample": f"WITH {READINGS} SELECT event_id, code, report_date FROM ev ORDER BY md5(event_id || ':42') LIMIT 60",
    "best_candidates": f"WITH {READINGS}, {SIGNALS}, ok AS (SELECT * FROM sig WHERE sue IS NOT NULL AND td IS NOT NULL) SELECT event_id, code, sue FROM ok WHERE td > (SELECT max(td) FROM ok) - 35 ORDER BY sue DESC, code, event_id LIMIT 20",
    "split_blocks": f"""WITH {READINGS}, dd AS (SELECT report_date, row_number() OVER (ORDER BY report_date) - 1 AS r, count(*) OVER () AS t FROM (SELECT DISTINCT report_date FROM ev WHERE report_date IS NOT NULL)),
bl AS (SELECT report_date, CAST(CASE WHEN r < (t % 5) * (t // 5 + 1) THEN r // (t // 5 + 1) ELSE (t % 5) + (r - (t % 5) * (t // 5 + 1)) // (t // 5) END AS INT) AS fold FROM dd),
te AS (SELECT fold, min(report_date) AS test_start, max(report_date) AS test_end, count(*) AS test_rows FROM ev JOIN bl USING (report_date) WHERE fold > 0 GROUP BY fold),
tr AS (SELECT *, (SELECT count(*) FROM ev WHERE ev.report_date < te.test_start - 60) AS train_rows FROM te)
SELECT * FROM tr WHERE train_rows >= 0.3 * (SELECT count(*) FROM ev)""",
    "flag_counts": FLAGS + "SELECT count(*) AS events, count_if(is_flagged) AS flagged, count_if(is_flagged IS NULL) AS unknown, count_if(flag_basis = 'history') AS by_history, count_if(flag_basis = 'current') AS by_current, count_if(flag_basis = 'unknown') AS by_unknown, round(avg(CAST(is_flagged AS INT)), 6) AS flagged_share FROM fl",
    "unflagged_events": FLAGS + "SELECT event_id, flag_basis, is_flagged FROM fl WHERE NOT coalesce(is_flagged, false)",
    "return_coverage": f"WITH {READINGS} SELECT count(*) AS events, " + ", ".join(f"round(avg(CAST(b{h}.close / b0.close IS NOT NULL AS INT)), 6) AS coverage_{h}, round(avg(round(b{h}.close / b0.close - 1, 6)), 6) AS mean_{h}" for h in HORIZONS) + " FROM ev LEFT JOIN cal ON cal.d = td LEFT JOIN bars b0 ON b0.code = ev.code AND b0.idx = cal.i " + " ".join(f"LEFT JOIN bars b{h} ON b{h}.code = ev.code AND b{h}.idx = cal.i + {h}" for h in HORIZONS) + " WHERE td IS NOT NULL",
    "seasonal_surprises": f"""WITH {READINGS}, s1 AS (SELECT *, eps - lag(eps, 4) OVER w AS unexpected, lag(revenue, 4) OVER w AS r4, lag(net_profit, 4) OVER w AS n4 FROM ev WINDOW w AS (PARTITION BY code ORDER BY report_date)),
s2 AS (SELECT *, CASE WHEN count(unexpected) OVER w >= 4 THEN stddev_samp(unexpected) OVER w END AS deviation, greatest(coalesce(max(abs(unexpected)) OVER (PARTITION BY code), 0), 1) AS most FROM s1 WINDOW w AS (PARTITION BY code ORDER BY report_date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT event_id, round(unexpected, 6) AS unexpected, round(deviation, 6) AS deviation, round(CASE WHEN deviation > 1e-10 * most THEN unexpected / deviation END, 6) AS sue, round((revenue - r4) / nullif(abs(r4), 0), 6) AS revenue_growth, round((net_profit - n4) / nullif(abs(n4), 0), 6) AS net_profit_growth FROM s2""",
    "ic_tables": TABLES + "SELECT signal, horizon, group_type, \"group\", n_obs, ic FROM tb WHERE ic IS NOT NULL",
    "ic_table_summary": TABLES + """, ok AS (SELECT * FROM tb WHERE ic IS NOT NULL)
SELECT signal, horizon, group_type, count(*) AS periods, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS std_ic, round(avg(CAST(ic > 0 AS INT)), 6) AS positive_rate, round(min(ic), 6) AS min_ic, round(max(ic), 6) AS max_ic, round(CASE WHEN count(*) >= 3 AND stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) END, 6) AS icir, round(CASE WHEN count(*) >= 3 AND stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) * sqrt(count(*)) END, 6) AS t_stat FROM ok GROUP BY ALL""",
    "capped_weights": CAPPED,
    "panel_order": f"WITH {READINGS} SELECT event_id, code, td AS tradable_date, row_number() OVER (ORDER BY td, code, event_id) - 1 AS place FROM ev WHERE td IS NOT NULL",
    "feature_matrix": ANALYSIS + f"SELECT event_id, {r('sue revenue_growth net_profit_growth eps_growth log_mcap momentum_20d volatility_20d log_adv20')} FROM ana WHERE 2 * (" + " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in "sue revenue_growth net_profit_growth eps_growth log_mcap momentum_20d volatility_20d log_adv20".split()) + ") >= 8",
    "scaled_features": ANALYSIS + """, dd AS (SELECT report_date, row_number() OVER (ORDER BY report_date) <= (count(*) OVER () + 1) // 2 AS early FROM (SELECT DISTINCT report_date FROM ana)),
tr AS (SELECT ana.* FROM ana JOIN dd USING (report_date) WHERE early),
md AS (SELECT """ + ", ".join(f"coalesce(median({c}), 0) AS m_{c}" for c in "sue log_mcap momentum_20d volatility_20d".split()) + """ FROM tr),
st AS (SELECT """ + ", ".join(f"any_value(m_{c}) AS m_{c}, avg(coalesce({c}, m_{c})) AS a_{c}, coalesce(nullif(stddev_samp(coalesce({c}, m_{c})), 0), 1) AS s_{c}" for c in "sue log_mcap momentum_20d volatility_20d".split()) + """ FROM tr, md)
SELECT event_id, """ + ", ".join(f"round((coalesce({c}, m_{c}) - a_{c}) / s_{c}, 6) AS {c}" for c in "sue log_mcap momentum_20d volatility_20d".split()) + " FROM ana JOIN dd USING (report_date), st WHERE NOT early",
    "prediction_scores": ANALYSIS + """, hd AS (SELECT * FROM engine QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY scored_ts DESC, score DESC) = 1),
pd AS (SELECT run_id, event_id, max(score) FILTER (isfinite(score)) AS prediction FROM hd GROUP BY ALL),
sc AS (SELECT run_id, report_date, ret_10, unnest(['prediction', 'surprise']) AS score, unnest([prediction, sue]) AS v FROM ana JOIN pd USING (event_id)),
rk AS (SELECT *, rank() OVER (PARTITION BY run_id, score, report_date ORDER BY v) + (count(*) OVER (PARTITION BY run_id, score, report_date, v) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY run_id, score, report_date ORDER BY ret_10) + (count(*) OVER (PARTITION BY run_id, score, report_date, ret_10) - 1) / 2.0 AS rb FROM sc WHERE v IS NOT NULL AND ret_10 IS NOT NULL)
SELECT run_id, score, report_date, count(*) AS n, CASE WHEN count(*) >= 20 AND min(v) < max(v) AND min(ret_10) < max(ret_10) THEN round(corr(ra, rb), 6) END AS ic FROM rk GROUP BY ALL""",
    "ridge_single": ANALYSIS + """, ok AS (SELECT event_id, report_date, sue, ret_10 AS y FROM ana WHERE ret_10 IS NOT NULL),
dd AS (SELECT report_date, row_number() OVER (ORDER BY report_date) - 1 AS r, count(*) OVER () AS t FROM (SELECT DISTINCT report_date FROM ok)),
bl AS (SELECT report_date, CASE WHEN r < (t % 4) * (t // 4 + 1) THEN r // (t // 4 + 1) ELSE (t % 4) + (r - (t % 4) * (t // 4 + 1)) // (t // 4) END AS b FROM dd),
te AS (SELECT b, min(report_date) AS a, max(report_date) AS z FROM bl WHERE b > 0 GROUP BY b),
tr AS (SELECT te.b, ok.* FROM te JOIN ok ON ok.report_date < te.a - 30),
kept AS (SELECT b, row_number() OVER (ORDER BY b) AS fold, coalesce(median(sue), 0) AS med FROM tr GROUP BY b HAVING count(*) >= 0.3 * (SELECT count(*) FROM ok)),
st AS (SELECT tr.b, any_value(fold) AS fold, any_value(med) AS med, avg(coalesce(sue, med)) AS m, coalesce(nullif(stddev_samp(coalesce(sue, med)), 0), 1) AS s, avg(y) AS ym FROM tr JOIN kept USING (b) GROUP BY tr.b),
w AS (SELECT tr.b, sum((coalesce(sue, med) - m) / s * (y - ym)) / (sum(((coalesce(sue, med) - m) / s) ** 2) + 1) AS w FROM tr JOIN st USING (b) GROUP BY tr.b)
SELECT event_id, CAST(fold AS INT) AS fold, round(ym + w * (coalesce(sue, med) - m) / s, 5) AS prediction FROM ok JOIN te ON ok.report_date BETWEEN te.a AND te.z JOIN st ON st.b = te.b JOIN w ON w.b = te.b""",
    "round_trip_costs": """WITH p AS (SELECT DISTINCT lpad(regexp_replace(translate(code, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g'), 6, '0') AS code, date, loaded_ts, price_id, amount FROM prices),
b AS (SELECT code, amount AS b, true AS ib FROM p QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC, loaded_ts DESC NULLS LAST, price_id DESC) = 1),
s AS (SELECT code, min(momentum_20d * adv20) AS s, true AS isd FROM liquidity GROUP BY code),
j AS (SELECT code, CASE WHEN ib THEN b ELSE 0 END AS b, CASE WHEN isd THEN s ELSE 0 END AS s FROM b FULL JOIN s USING (code))
SELECT code, round(CASE WHEN b >= 0 AND s >= 0 THEN (b + s) * 0.0003::DOUBLE + s * 0.0005::DOUBLE + (b + s) * 0.003::DOUBLE END, 4) AS cost FROM j""",
    "present_features": ANALYSIS + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS present, round(count({c}) / count(*), 4) AS share FROM ana" for c in ("sue", "prev_close", "adv20", "volatility_20d", "momentum_20d", "float_mcap", "log_mcap", "log_adv20", "ret_10")),
}
