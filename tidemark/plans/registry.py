"""Queries and their SQL by name."""

from __future__ import annotations

from tidemark.plans import market, panel, panel_sql, raw, raw_sql
from tidemark.sources.tables import PLAIN_FORMS, WIDE_FORMS

QUERIES = {name: getattr(market, name) for name in ("p1_found", "p1_trailing", "p3_found", "p3_known", "p5_found", "p5_grid", "p6_found", "p6_flags", "p7_found", "p7_versions")}

QUERIES |= {name: getattr(panel, name) for name in panel.NAMES} | {name: getattr(raw, name) for name in raw.NAMES}

#: Current readings in canonical form, as SQL.
READINGS = r"""
canon AS (SELECT DISTINCT lpad(regexp_replace(translate(code, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g'), 6, '0') AS code, price_id, date, close, volume, amount, pct_change, loaded_ts FROM prices),
readings AS (SELECT * FROM canon QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY loaded_ts DESC NULLS LAST, price_id DESC) = 1),
sess AS (SELECT r.*, CAST(c.session_date AS DATE) AS session_date, c.session_idx FROM readings r JOIN trade_calendar c ON CAST(r.date AS DATE) = CAST(c.session_date AS DATE))
"""

SQL = {
    "p1_found": f"""WITH {READINGS},
daily AS (SELECT code, session_idx, coalesce(sum(amount), 0) AS amount, product(1 + pct_change / 100) - 1 AS ret FROM sess GROUP BY ALL),
firsts AS (SELECT code, min(session_idx) AS first_idx FROM daily GROUP BY code),
grid AS (SELECT f.code, c.session_idx, c.session_date, f.first_idx, d.amount, d.ret FROM firsts f JOIN trade_calendar c ON c.session_idx >= f.first_idx LEFT JOIN daily d ON d.code = f.code AND d.session_idx = c.session_idx),
win AS (SELECT code, session_idx, CAST(session_date AS DATE) AS session_date, first_idx, coalesce(sum(amount) OVER w, 0) / 20 AS adv, count(ret) OVER w AS n, stddev_samp(ret) OVER w AS vol, product(1 + ret) OVER w - 1 AS mom FROM grid WINDOW w AS (PARTITION BY code ORDER BY session_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
held AS (SELECT l.*, w.adv, w.n, w.vol, w.mom FROM liquidity l JOIN win w ON w.code = l.code AND w.session_date = CAST(l.date AS DATE) WHERE w.session_idx - w.first_idx >= 20)
SELECT DISTINCT liq_id, field FROM (
SELECT liq_id, 'adv20' AS field FROM held WHERE abs(adv20 - adv) > 0.005 * adv
UNION ALL SELECT liq_id, 'volatility_20d' FROM held WHERE n >= 10 AND abs(volatility_20d - vol) > 0.0005
UNION ALL SELECT liq_id, 'momentum_20d' FROM held WHERE abs(momentum_20d - coalesce(mom, 0)) > 0.0005)""",
    "p3_found": """WITH ev AS (SELECT DISTINCT event_id, code, report_date, actual_disclosure_date, tradable_ts FROM event_panel WHERE tradable_ts IS NOT NULL)
SELECT event_id, 'st' AS attr, "序号" AS row_id FROM ev JOIN sample_audit a ON a."股票代码" = ev.code AND a."当时ST" IS NOT NULL AND a."实际披露日" <= ev.actual_disclosure_date AND a.audit_ts <= ev.tradable_ts
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY "实际披露日" DESC, audit_ts DESC, "序号" DESC) = 1
UNION ALL SELECT event_id, 'correction', scan_id FROM ev JOIN correction_scan s ON s.code = ev.code AND s.report_date = ev.report_date AND s.scan_ts <= ev.tradable_ts AND s.report_corrected IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY scan_ts DESC, scan_id DESC) = 1""",
    "p5_found": f"""WITH {READINGS},
t AS (SELECT DISTINCT code, session_idx FROM sess WHERE close IS NOT NULL AND volume > 0),
span AS (SELECT code, min(session_idx) AS a, max(session_idx) AS b FROM t GROUP BY code)
SELECT span.code, strftime(c.session_date, '%Y-%m-%d') AS session_date FROM span JOIN trade_calendar c ON c.session_idx BETWEEN a AND b ANTI JOIN t ON t.code = span.code AND t.session_idx = c.session_idx""",
    "p6_found": f"""WITH {READINGS},
t AS (SELECT code, date, price_id, close FROM sess WHERE close IS NOT NULL AND volume > 0),
runs AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date, price_id) - row_number() OVER (PARTITION BY code, close ORDER BY date, price_id) AS g FROM t),
stuck AS (SELECT price_id FROM runs QUALIFY count(*) OVER (PARTITION BY code, close, g) >= 6),
ok AS (SELECT code, date, price_id, ln(close) AS x FROM t WHERE close > 0 AND close <= 1000000),
e AS (SELECT *, x - lag(x) OVER w AS b, x - lead(x) OVER w AS f FROM ok WINDOW w AS (PARTITION BY code ORDER BY date, price_id)),
med AS (SELECT code, 12 * median(abs(b)) AS lim FROM e GROUP BY code),
near AS (SELECT e.*, lim, lead(f) OVER w AS f2, lag(b) OVER w AS b2 FROM e JOIN med USING (code) WINDOW w AS (PARTITION BY code ORDER BY date, price_id)),
spike AS (SELECT price_id FROM near WHERE (b > lim AND f > lim) OR (b < -lim AND f < -lim) OR (b > lim AND f2 > lim) OR (b < -lim AND f2 < -lim) OR (b2 > lim AND f > lim) OR (b2 < -lim AND f < -lim)),
q AS (SELECT DISTINCT quote_id, lpad(regexp_replace(translate(code, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g'), 6, '0') AS code, date, limit_up, limit_down, corporate_action FROM feed WHERE suspended = false),
qm AS (SELECT code, median(limit_up / nullif(limit_down, 0)) AS usual FROM q GROUP BY code),
qr AS (SELECT *, row_number() OVER o - row_number() OVER (PARTITION BY code, limit_up, limit_down ORDER BY date, quote_id) AS g, row_number() OVER o - row_number() OVER (PARTITION BY code, corporate_action ORDER BY date, quote_id) AS h FROM q WINDOW o AS (PARTITION BY code ORDER BY date, quote_id)),
qn AS (SELECT *, count(*) OVER (PARTITION BY code, limit_up, limit_down, g) AS n, count(*) OVER (PARTITION BY code, corporate_action, h) AS m FROM qr)
SELECT DISTINCT tbl, row_id FROM (
SELECT 'prices' AS tbl, price_id AS row_id FROM t WHERE close <= 0 OR close > 1000000
UNION ALL SELECT 'prices', price_id FROM stuck UNION ALL SELECT 'prices', price_id FROM spike
UNION ALL SELECT 'feed', quote_id FROM q JOIN qm USING (code) WHERE limit_up <= 0 OR abs(limit_up / nullif(limit_down, 0) / usual - 1) > 0.03
UNION ALL SELECT 'feed', quote_id FROM qn WHERE (n >= 6 AND limit_up IS NOT NULL AND limit_down IS NOT NULL) OR (m >= 4 AND corporate_action))""",
    "p7_found": r"""WITH a AS (SELECT DISTINCT * FROM sample_audit),
obs AS (SELECT "股票代码" AS entity, 'name' AS attr, audit_ts AS seen, lower(regexp_replace(translate("当前简称", 'WIDE', 'PLAIN'), '[\s\p{Z}]+', '', 'g')) AS v FROM a
UNION ALL SELECT * FROM (SELECT "股票代码", 'name_at_disclosure', CAST("实际披露日" AS TIMESTAMP), lower(regexp_replace(translate("披露日当时简称", 'WIDE', 'PLAIN'), '[\s\p{Z}]+', '', 'g')) AS v FROM a WHERE v <> '' QUALIFY row_number() OVER (PARTITION BY "股票代码", "实际披露日" ORDER BY audit_ts DESC, v DESC) = 1)
UNION ALL SELECT strftime(report_date, '%Y-%m-%d'), 'st_basis_sh_current', run_ts, CAST(st_basis_sh_current AS VARCHAR) FROM data_audit),
said AS (SELECT * FROM obs WHERE v IS NOT NULL AND v <> ''),
steps AS (SELECT *, lag(v) OVER (PARTITION BY entity, attr ORDER BY seen, v) AS p FROM said)
SELECT DISTINCT entity, attr, strftime(seen, '%Y-%m-%d') AS valid_from FROM steps WHERE p IS NULL OR p <> v""",
}
SQL["p7_found"] = SQL["p7_found"].replace("'WIDE'", f"'{WIDE_FORMS}'").replace("'PLAIN'", "'" + PLAIN_FORMS.replace("'", "''") + "'")
SQL |= panel_sql.SQL | raw_sql.SQL

_WINDOW = "coalesce(sum(a) OVER {w}, 0) AS amount_{n}, count(r) OVER {w} AS n_ret_{n}, sum(r) OVER {w} AS ret_{n}, stddev_samp(r) OVER {w} AS ret_std_{n}, product(1 + r) OVER {w} - 1 AS compound_{n}"
_SHOWN = "round(amount_{n}, 4) AS amount_{n}, round(amount_{n} / {k}, 4) AS amount_avg_{n}, n_ret_{n}, round(ret_{n}, 10) AS ret_{n}, round(ret_{n} / nullif(n_ret_{n}, 0), 12) AS ret_avg_{n}, round(ret_std_{n}, 10) AS ret_std_{n}, round(compound_{n}, 10) AS compound_{n}"

SQL["p1_trailing"] = f"""WITH {READINGS},
daily AS (SELECT code, session_date AS day, session_idx AS i, coalesce(sum(amount), 0) AS a, product(1 + pct_change / 100) - 1 AS r FROM sess GROUP BY ALL),
firsts AS (SELECT code, min(day) AS since, min(i) AS i0 FROM daily GROUP BY code),
grid AS (SELECT code, since, CAST(unnest(generate_series(since, (SELECT max(session_date) FROM trade_calendar), INTERVAL 1 DAY)) AS DATE) AS day FROM firsts),
g AS (SELECT grid.*, a, r, daily.i IS NOT NULL AS active, (SELECT max(c.session_idx) FROM trade_calendar c WHERE CAST(c.session_date AS DATE) <= grid.day) AS li FROM grid LEFT JOIN daily ON daily.code = grid.code AND daily.day = grid.day),
d AS (SELECT code, since, day, active, li, {_WINDOW.format(w="w7", n="7d")}, {_WINDOW.format(w="w30", n="30d")} FROM g WINDOW w7 AS (PARTITION BY code ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY code ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
sg AS (SELECT f.code, c.session_idx AS li, daily.a, daily.r FROM firsts f JOIN trade_calendar c ON c.session_idx >= f.i0 LEFT JOIN daily ON daily.code = f.code AND daily.i = c.session_idx),
s AS (SELECT code, li, {_WINDOW.format(w="w20", n="20s")} FROM sg WINDOW w20 AS (PARTITION BY code ORDER BY li ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT d.code, day, active, since, {_SHOWN.format(n="7d", k=7)}, {_SHOWN.format(n="30d", k=30)}, {_SHOWN.format(n="20s", k=20)} FROM d JOIN s ON s.code = d.code AND s.li = d.li"""
SQL["p3_known"] = f"""WITH f AS ({SQL["p3_found"]}), e AS (SELECT DISTINCT event_id FROM event_panel WHERE tradable_ts IS NOT NULL),
a AS (SELECT DISTINCT "序号" AS n, "当时ST" AS is_st FROM sample_audit), c AS (SELECT DISTINCT scan_id, report_corrected FROM correction_scan)
SELECT e.event_id, s.row_id AS st_row, is_st, k.row_id AS scan_row, report_corrected FROM e LEFT JOIN f s ON s.event_id = e.event_id AND s.attr = 'st' LEFT JOIN a ON a.n = s.row_id LEFT JOIN f k ON k.event_id = e.event_id AND k.attr = 'correction' LEFT JOIN c ON c.scan_id = k.row_id"""
SQL["p7_versions"] = SQL["p7_found"].partition("SELECT DISTINCT entity, attr, strftime")[0] + """, starts AS (SELECT *, lead(seen) OVER (PARTITION BY entity, attr ORDER BY seen) AS nx FROM steps WHERE p IS NULL OR p <> v)
SELECT entity, attr, v AS value, strftime(seen, '%Y-%m-%d') AS valid_from, strftime(nx, '%Y-%m-%d') AS valid_to, nx IS NULL AS current FROM starts"""
SQL["scenario_rollup"] = f"""SELECT split_part(scenario, ':', 1) AS dimension, count(*) AS variants, round(avg(net_annual), 4) AS mean, round(avg(CAST(net_annual > 0 AS INT)), 4) AS positive_share FROM ({SQL["scenario_metrics"]}) GROUP BY 1"""
SQL["findings"] = f"""WITH i AS ({SQL["ic_statistics"]}), m AS ({SQL["scenario_metrics"]})
SELECT scenario, mean_ic, t_stat, net_annual, net_information_ratio, CASE WHEN mean_ic > 0 AND t_stat >= 2 AND net_annual > 0 AND net_information_ratio > 0 THEN 'confirmed' WHEN mean_ic > 0 AND t_stat >= 2 THEN 'informative, not profitable' WHEN net_annual > 0 AND net_information_ratio > 0 THEN 'profitable, not informative' ELSE 'rejected' END AS verdict FROM i JOIN m ON m.scenario = 'horizon:' || horizon"""

SQL["p5_grid"] = f"""WITH {READINGS},
t AS (SELECT code, date AS a, session_idx AS i, max(close) AS v, sum(volume) AS q FROM sess WHERE close IS NOT NULL AND volume > 0 GROUP BY ALL),
u AS (SELECT *, lead(a) OVER w AS z, coalesce(lead(i) OVER w, i) AS j FROM t WINDOW w AS (PARTITION BY code ORDER BY a)),
c AS (SELECT u.*, k.session_date AS day, k.session_idx AS n, CAST(k.session_date AS TIMESTAMP) AS d0, CAST(k.session_date AS TIMESTAMP) + INTERVAL 1 DAY AS d1 FROM u JOIN trade_calendar k ON k.session_idx BETWEEN u.i AND u.j),
h AS (SELECT *, greatest(epoch_us(least(coalesce(z, d1), d1)) - epoch_us(greatest(a, d0)), 0)::DOUBLE AS held FROM c),
g AS (SELECT code, day, count(*) FILTER (n = i) AS n_readings, arg_max(v, a) AS last_value, sum(held * v) / nullif(sum(held), 0) AS mean, sum(q) FILTER (n = i) AS total_amount, sum(held) / 86400000000 AS coverage FROM h GROUP BY code, day)
SELECT code, CAST(day AS DATE) AS session_date, n_readings, last_value, round(coalesce(mean, last_value), 6) AS mean_value, round(total_amount, 2) AS total_amount, round(coverage, 9) AS coverage, CASE WHEN n_readings > 0 THEN 'observed' ELSE 'filled' END AS status FROM g"""


def _passes(passes: int = 3, reach: int = 4) -> str:
    """CTEs s1 to s{passes} of the repeated outlier tests over e, each with what they take out."""
    over = "OVER (PARTITION BY code ORDER BY date, price_id)"
    near = lambda side, v, k: "coalesce(" + ", ".join(f"{side}({v}, {i}) {over}" for i in range(1, k + 1)) + ")"
    part = lambda b: f"(CASE WHEN {b} IS NULL THEN 0 ELSE th * greatest(least({b}, 3 * sc), -3 * sc) END)"
    steps = {"0": ("d", "p1"), "1": ("n1", "d"), "2": ("n2", "n1"), "-1": ("p1", "p2")}

    def beyond(step: str, sign: str, fit: bool) -> str:
        d, before = steps[step]
        e = part(before) if fit else "0"
        return f"coalesce({sign}({d} - {e}) + abs({e}) > 12 * sc, false)"

    def reversed_move(fit: bool) -> str:
        return " OR ".join(f"({beyond(a, s, fit)} AND {beyond(b, r, fit)})" for a, b in (("0", "1"), ("0", "2"), ("-1", "1")) for s, r in (("", "-"), ("-", "")))

    out = []
    for t in range(1, passes + 1):
        k = 1 if t == 1 else reach
        if t > 1:
            out += [
                f"a{t} AS (SELECT code, date, price_id, x, th, sc, strict, gone, shift OR (large AND NOT new AND NOT coalesce(lag(new) {over}, false) AND NOT coalesce(lead(new) {over}, false)) AS shift FROM s{t - 1})",
                f"b{t} AS (SELECT *, CASE WHEN gone IS NULL THEN CASE WHEN shift THEN 0 ELSE x - {near('lag', 'CASE WHEN gone IS NULL THEN x END', k)} END END AS d FROM a{t})",
                f"c{t} AS (SELECT *, {near('lag', 'd', k)} AS p1, {near('lead', 'd', k)} AS n1 FROM b{t})",
            ]
        source = "e" if t == 1 else f"c{t}"
        out.append(f"f{t} AS (SELECT *, {near('lag', 'CASE WHEN gone IS NULL THEN p1 END', k)} AS p2, {near('lead', 'CASE WHEN gone IS NULL THEN n1 END', k)} AS n2 FROM {source})")
        strict = f"{reversed_move(False)}" if t == 1 else "strict"
        out.append(f"g{t} AS (SELECT * REPLACE ({strict} AS strict), gone IS NULL AND ({reversed_move(True)}) AS new, gone IS NULL AND coalesce(abs(d - {part('p1')}) > 12 * sc, false) AS large FROM f{t})")
        out.append(f"s{t} AS (SELECT * REPLACE (CASE WHEN new THEN {t} ELSE gone END AS gone) FROM g{t})")
    return ",\n".join(out)


SQL["p6_flags"] = SQL["p6_found"].partition("ok AS (SELECT code, date, price_id, ln(close)")[0] + f"""
ok AS (SELECT code, date, price_id, ln(close) AS x FROM t WHERE close > 0 AND close <= 1000000),
e0 AS (SELECT *, x - lag(x) OVER (PARTITION BY code ORDER BY date, price_id) AS d FROM ok),
e1 AS (SELECT *, lag(d) OVER w AS p1, lead(d) OVER w AS n1 FROM e0 WINDOW w AS (PARTITION BY code ORDER BY date, price_id)),
fit AS (SELECT code, median(abs(d)) AS sc, coalesce(sin(avg(sign(d) * sign(p1)) FILTER (d * p1 <> 0) * pi() / 2) * count(*) FILTER (d * p1 <> 0) / (count(*) FILTER (d * p1 <> 0) + 30), 0) AS th FROM e1 GROUP BY code),
e AS (SELECT e1.*, th, sc, NULL::INT AS gone, false AS shift, false AS strict FROM e1 JOIN fit USING (code)),
{_passes()},
q AS""" + SQL["p6_found"].partition("q AS")[2].partition("SELECT DISTINCT tbl, row_id FROM (")[0] + """SELECT DISTINCT tbl, code, row_id, reason, in_pass, strict FROM (
SELECT 'prices' AS tbl, code, price_id AS row_id, 'limit' AS reason, 1 AS in_pass, true AS strict FROM t WHERE close <= 0 OR close > 1000000
UNION ALL SELECT 'prices', code, price_id, 'stuck', 1, true FROM t WHERE price_id IN (SELECT price_id FROM stuck)
UNION ALL SELECT 'prices', code, price_id, 'spike', gone, strict FROM s3 WHERE gone IS NOT NULL
UNION ALL SELECT 'feed', code, quote_id, 'limit', 1, true FROM q JOIN qm USING (code) WHERE limit_up <= 0 OR abs(limit_up / nullif(limit_down, 0) / usual - 1) > 0.03
UNION ALL SELECT 'feed', code, quote_id, 'stuck', 1, true FROM qn WHERE n >= 6 AND limit_up IS NOT NULL AND limit_down IS NOT NULL
UNION ALL SELECT 'feed', code, quote_id, 'action', 1, true FROM qn WHERE m >= 4 AND corporate_action)"""
