"""SQL of the source queries: what the vendors' tables must come out as, from the market tables themselves."""

from __future__ import annotations

from tidemark.plans.panel_sql import FLAGS, NAMES, READINGS, SQL as PANEL

LIVES = """
life AS (SELECT code, min(date) AS a, max(date) AS z FROM bars GROUP BY code),
lst AS (SELECT code, CASE WHEN code >= '600000' THEN 'S' || code ELSE 'Z' || code END AS name, CASE WHEN code >= '600000' THEN a ELSE a + 1 END AS list_date, CASE WHEN code >= '600000' THEN 'SH' ELSE 'SZ' END AS exchange FROM life WHERE code >= '300000' OR code < '200000'),
gone AS (SELECT code, CASE WHEN code >= '600000' THEN z ELSE z + 2 END AS delist_date, CASE WHEN code >= '600000' THEN 'SH' ELSE 'SZ' END AS exchange FROM life WHERE z < (SELECT max(d) FROM cal) - 40)
"""
SQL = {
    "vendor_financials": f"WITH {READINGS} SELECT code, report_date, name, industry, disc AS latest_notice_date, NULL::DOUBLE AS roe, round(eps, 3) AS eps, round(revenue, 3) AS revenue, round(net_profit, 3) AS net_profit FROM ev",
    "vendor_announcements": "SELECT DISTINCT code, first_scheduled, actual_disclosure_date, report_date, CAST(first_scheduled IS DISTINCT FROM actual_disclosure_date AS INT) AS schedule_changes, actual_disclosure_date AS ann_ts FROM event_panel WHERE actual_disclosure_date IS NOT NULL",
    "told_filings": "SELECT DISTINCT code, report_date, round(eps, 3) AS eps, actual_disclosure_date, CAST(first_scheduled IS DISTINCT FROM actual_disclosure_date AS INT) AS schedule_changes FROM event_panel WHERE actual_disclosure_date IS NOT NULL",
    "built_panel": FLAGS + f""", {LIVES},
p AS (SELECT ev.*, (SELECT min(d) FROM cal WHERE d > disc) AS tradable FROM ev WHERE disc IS NOT NULL)
SELECT code || ':' || strftime(report_date, '%Y-%m-%d') AS event_id, code, report_date, disc AS actual_disclosure_date, tradable AS tradable_date, flag_basis, is_flagged
FROM p JOIN fl USING (event_id) JOIN lst USING (code) LEFT JOIN gone USING (code) WHERE tradable IS NOT NULL AND list_date <= disc AND (delist_date IS NULL OR delist_date > disc) AND NOT coalesce(is_flagged, false)""",
    "vendor_bars": f"""WITH {READINGS}, m AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY date) AS p FROM bars)
SELECT code, date, CASE WHEN date < DATE '2023-01-01' THEN 'a' ELSE 'b' END AS source, round(close, 3) AS close, round(amount, 1) AS amount, volume, round(turnover, 4) AS turnover, CASE WHEN date >= DATE '2023-01-01' THEN round((close / p - 1) * 100, 4) END AS pct_change FROM m""",
    "vendor_adjusted": f"WITH {READINGS} SELECT code, date, 'hfq' AS adjust, round(close, 3) AS close FROM bars WHERE date < DATE '2023-01-01'",
    "vendor_actions": """WITH q AS (SELECT DISTINCT lpad(regexp_replace(translate(code, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g'), 6, '0') AS code, date, close AS c, CASE WHEN limit_up > 1.15::DOUBLE * close THEN limit_up END AS s FROM feed WHERE corporate_action)
SELECT code, last_day(date) AS report_date, date AS ex_date, CASE WHEN s > 0 AND c > 0 THEN '送转+分红' WHEN s > 0 THEN '送转' WHEN c > 0 THEN '分红' ELSE '其他' END AS type, round(coalesce(c, 0) / 10, 4) AS cash_dividend_per_share, round(coalesce(s, 0) / 10, 4) AS share_ratio FROM q WHERE date IS NOT NULL""",
    "vendor_listings": f"WITH {READINGS}, {LIVES} SELECT * FROM lst",
    "vendor_delistings": f"WITH {READINGS}, {LIVES} SELECT code, delist_date, exchange, '退市' AS delist_type FROM gone",
    "vendor_renames": f"WITH {READINGS}, {NAMES} SELECT code, cd AS change_date, b AS name_before, a AS name_after FROM chg",
    "vendor_eps": f"WITH {READINGS} SELECT code, report_date, round(eps, 3) AS eps_raw FROM ev WHERE year(report_date) >= 2022",
    "vendor_calendar": "SELECT CAST(session_date AS DATE) AS session_date, CAST(row_number() OVER (ORDER BY session_date) - 1 AS INT) AS session_idx FROM trade_calendar",
    "vendor_quotes": f"WITH {READINGS} SELECT code, round(arg_max(close, date), 3) AS price FROM bars GROUP BY code",
    "code_traits": f"""WITH {READINGS}, c AS (SELECT DISTINCT code FROM canon)
SELECT code, CASE WHEN code[1] IN ('6', '9') THEN 'sh' WHEN code[1] IN ('8', '4') THEN 'bj' ELSE 'sz' END || code AS symbol, code[1:3] IN ('600', '601', '603', '605', '000', '001', '002', '003') AS main_board,
CASE WHEN code[1:3] IN ('688', '689', '300', '301') THEN 0.2::DOUBLE WHEN code[1] IN ('8', '4') THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS band, CASE WHEN code[1:3] IN ('688', '689', '300', '301') THEN 0.2::DOUBLE WHEN code[1] IN ('8', '4') THEN 0.3::DOUBLE ELSE 0.05::DOUBLE END AS flagged_band FROM c""",
    "unseen_events": "SELECT DISTINCT event_id, code FROM event_panel WHERE event_id NOT IN (SELECT event_id FROM engine WHERE event_id IS NOT NULL)",
    "audits_beside": f"SELECT p.events AS panel_events, p.codes AS panel_codes, p.periods AS panel_periods, p.first_report AS panel_first_report, p.last_entry AS panel_last_entry, p.early AS panel_early, p.late AS panel_late, c.events AS coverage_events, c.audited AS coverage_audited, c.matched AS coverage_matched, c.events_only AS coverage_events_only, c.audited_only AS coverage_audited_only FROM ({PANEL['panel_audit']}) p, ({PANEL['coverage_audit']}) c",
    "quotes_as_json": """WITH q AS (SELECT DISTINCT quote_id, open, high, low, close, suspended FROM feed)
SELECT quote_id, open, close, suspended, 64 AS digest_length, coalesce(low <= open AND open <= high, coalesce(low <= open, true) AND coalesce(open <= high, true)) AND coalesce(low <= close AND close <= high, coalesce(low <= close, true) AND coalesce(close <= high, true)) AS sane FROM q""",
    "stored_calendar": "SELECT CAST(session_date AS DATE) AS session_date, session_idx FROM trade_calendar",
    "store_listing": """SELECT 'trade_calendar' AS interface, '{"part": "all"}' AS params, count(*) AS rows, 2 AS columns, 64 AS digits FROM trade_calendar UNION ALL SELECT 'subjects', '{"part": "all"}', count(*), 2, 64 FROM subjects""",
    "saved_panel": f"WITH {READINGS} SELECT event_id, code, report_date, eps FROM ev",
    "saved_results": f"SELECT events, codes, periods, 4 AS lag, 6 AS horizons FROM ({PANEL['panel_audit']})",
    "account_commits": """WITH s AS (SELECT CAST(run_id AS VARCHAR) AS account, CAST(cohort[1:4] AS INT) * 12 + CAST(cohort[6:7] AS INT) AS session_idx, coalesce(round(gross_return, 6), 0) AS amount FROM backtest_cohorts),
g AS (SELECT *, session_idx - min(session_idx) OVER (PARTITION BY account) = row_number() OVER (PARTITION BY account ORDER BY session_idx) - 1 AS ok FROM s)
SELECT account, session_idx, CASE WHEN ok THEN 'applied' ELSE 'rejected' END AS status, CASE WHEN ok THEN '' ELSE 'gap' END AS reason, round(coalesce(sum(amount) FILTER (ok) OVER (PARTITION BY account ORDER BY session_idx), 0), 6) AS balance FROM g""",
}
