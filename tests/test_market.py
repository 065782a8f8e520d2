"""Hand-computed cases of the event-study operators."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import backtest, bars, crosssection, factor, fills, models, portfolio, security, sequence, sessions, signals
from tidemark.sources.tables import canonical_code, plain_name


def weekdays(n, start=date(2024, 1, 1)):
    days = [start + timedelta(days=k) for k in range(2 * n + 10)]
    return [d for d in days if d.weekday() < 5][:n]


def cal(spark, n=40):
    return spark.createDataFrame([(d, i) for i, d in enumerate(weekdays(n))], "session_date date, session_idx int")


def test_codes_and_names(spark):
    raw = ["600001", "1", "sh600001", "000002.SZ", "６００００１", " 3 ", "", None, "1234567"]
    got = [x.c for x in spark.createDataFrame([(x,) for x in raw], "x string").select(canonical_code("x").alias("c")).collect()]
    assert got == ["600001", "000001", "600001", "000002", "600001", "000003", None, None, "1234567"]
    got = [x.c for x in spark.createDataFrame([("ＳＴ 甲",), ("st甲　",), (" ",), (None,)], "x string").select(plain_name("x").alias("c")).collect()]
    assert got == ["st甲", "st甲", None, None]


def test_scalars(spark):
    df = spark.createDataFrame([("1,234.5", "688001", True), ("--", "300001", True), (None, "600000", True), ("x", "830001", False)], "s string, code string, st boolean")
    got = df.select(scalars.parse_number(F.col("s")).alias("n"), scalars.price_band(F.col("code"), F.col("st")).alias("b"), scalars.main_board(F.col("code")).alias("m"), scalars.exchange_symbol(F.col("code")).alias("e")).collect()
    assert [x.n for x in got] == [1234.5, None, None, None]
    assert [x.b for x in got] == [0.2, 0.2, 0.05, 0.3]
    assert [x.m for x in got] == [False, False, True, False]
    assert [x.e for x in got] == ["sh688001", "sz300001", "sh600000", "bj830001"]
    one = spark.range(1).select(scalars.cents(F.lit(0.125)).alias("even"), scalars.tick(F.lit(0.125)).alias("up"), scalars.commission(F.lit(-1.0)).alias("neg"), scalars.order_cap(F.lit(None).cast("double")).alias("cap")).first()
    assert (one.even, one.up, one.neg, one.cap) == (0.12, 0.13, None, 0.0)
    with pytest.raises(ValueError):
        scalars.order_cap(F.lit(1.0), 1.5)


def test_calendar(spark):
    days = [date(2024, 1, d) for d in (2, 3, 4, 5, 8, 9, 10, 11, 12)]
    c = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "session_date date, session_idx int")
    index = sessions.day_index(c)
    df = spark.createDataFrame([(date(2024, 1, 3),), (date(2024, 1, 5),), (date(2024, 1, 6),), (date(2024, 1, 12),), (date(2023, 1, 1),), (None,)], "d date")
    got = {x.d: x for x in sessions.tradable(sessions.shift(sessions.shift(df, "d", index, c, 1, "p1"), "d", index, c, -1, "m1"), "d", index, c, 1, "t1").collect()}
    assert (got[date(2024, 1, 3)].p1, got[date(2024, 1, 3)].m1, got[date(2024, 1, 3)].t1) == (date(2024, 1, 4), date(2024, 1, 2), date(2024, 1, 4))
    assert (got[date(2024, 1, 6)].p1, got[date(2024, 1, 6)].m1, got[date(2024, 1, 6)].t1) == (date(2024, 1, 9), date(2024, 1, 4), date(2024, 1, 8))
    assert (got[date(2024, 1, 12)].p1, got[date(2024, 1, 12)].t1) == (None, None)
    assert got[None].t1 is None and got[date(2023, 1, 1)].t1 == date(2024, 1, 2)
    with pytest.raises(ValueError):
        sessions.tradable(df, "d", index, c, -1)
    span = spark.createDataFrame([(date(2024, 1, 3), date(2024, 1, 9)), (date(2024, 1, 6), date(2024, 1, 7))], "a date, z date")
    assert [x.sessions for x in sessions.sessions_between(span, "a", "z", index).orderBy("a").collect()] == [5, 0]


def test_names_and_universe(spark):
    changes = spark.createDataFrame([("1", date(2020, 1, 1), "甲", "ST甲"), ("1", date(2021, 1, 1), "ST甲", "*ST甲"), ("1", date(2022, 1, 1), "*ST甲", "甲")], "code string, change_date date, name_before string, name_after string")
    events = spark.createDataFrame([("a", "1", date(2019, 5, 1), "甲"), ("b", "1", date(2020, 1, 1), "甲"), ("c", "1", date(2021, 6, 1), "甲"), ("d", "1", date(2022, 6, 1), "甲"), ("e", "2", date(2022, 6, 1), "ST乙"), ("f", "3", date(2022, 6, 1), None)], "event_id string, code string, d date, name string")
    got = {x.event_id: (x.flag_basis, x.is_flagged) for x in security.flag_status(events, security.name_timeline(changes), "d", "name").collect()}
    assert got == {"a": ("history", False), "b": ("history", True), "c": ("history", True), "d": ("history", False), "e": ("current", True), "f": ("unknown", None)}
    kept = security.drop_flagged(security.flag_status(events, security.name_timeline(changes), "d", "name"))
    assert {x.event_id for x in kept.collect()} == {"a", "d", "f"}
    listing = spark.createDataFrame([("1", date(2019, 5, 1)), ("2", date(2022, 7, 1))], "code string, list_date date")
    delisting = spark.createDataFrame([("1", date(2022, 6, 1))], "code string, delist_date date")
    assert {x.event_id for x in security.listed(events, listing, delisting, "d").collect()} == {"a", "b", "c"}


def test_corrections(spark):
    events = spark.createDataFrame([("a", "1", date(2023, 12, 31), date(2024, 3, 1))], "event_id string, code string, report_date date, d date")
    titles = spark.createDataFrame([("1", date(2024, 3, 1), "年度报告更正"), ("1", date(2024, 3, 2), "年度报告更正公告"), ("1", date(2024, 6, 29), "章程修订"), ("1", date(2024, 6, 30), "更正"), ("1", date(2024, 4, 1), "其他"), ("1", date(2024, 4, 2), "补充说明"), ("1", date(2024, 4, 3), "勘误"), ("2", date(2024, 4, 1), "更正")], "code string, date date, title string")
    x = security.corrections(events, titles, "d").first()
    assert (x.announcements, x.corrections, x.report_corrections, x.report_corrected, x.titles) == (5, 3, 1, True, "年度报告更正公告 | 勘误 | 章程修订")
    labels = spark.createDataFrame([(date(2024, 3, 31),), (date(2024, 9, 30),), (date(2024, 5, 1),)], "d date").select(scalars.report_label(F.col("d")).alias("x"))
    assert [r.x for r in labels.collect()] == ["第一季度报告", "第三季度报告", "报告"]
    audit = security.correction_audit(security.corrections(events, titles, "d")).first()
    assert (audit.events, audit.with_announcements, audit.corrected, audit.corrected_rate) == (1, 1, 1, 1.0)


def test_limits_suspensions_adjustment(spark):
    days = weekdays(4)
    df = spark.createDataFrame([("600001", days[0], 10.0), ("600001", days[1], 11.0), ("600001", days[3], 9.9), ("688001", days[0], 10.0), ("688001", days[1], 11.0)], "code string, date date, close double")
    got = {(x.code, x.date): (x.hit_up, x.hit_down) for x in bars.limit_moves(df).collect()}
    assert got["600001", days[1]] == (True, False) and got["600001", days[3]] == (False, True) and got["688001", days[1]] == (False, False)
    assert [tuple(x) for x in bars.suspensions(df, cal(spark)).collect()] == [("600001", days[2])]
    split = spark.createDataFrame([("1", d, c) for d, c in zip(days, (10.0, 10.0, 5.0, 5.0))], "code string, date date, close double")
    act = spark.createDataFrame([("1", days[2], 0.0, 1.0), ("1", date(2023, 1, 1), 1.0, 0.0)], "code string, ex_date date, cash_dividend_per_share double, share_ratio double")
    assert [round(x.adj_close, 9) for x in bars.adjust(split, act, "qfq").orderBy("date").collect()] == [5, 5, 5, 5]
    assert [round(x.adj_close, 9) for x in bars.adjust(split, act, "hfq").orderBy("date").collect()] == [10, 10, 10, 10]
    with pytest.raises(ValueError):
        bars.adjust(split, act, "other")


def test_features_use_only_the_past(spark):
    days = weekdays(30)
    df = spark.createDataFrame([("1", d, 10.0 + i, 100.0 * (i + 1), 2.0) for i, d in enumerate(days)], "code string, date date, close double, amount double, turnover double")
    e = spark.createDataFrame([("e", "1", days[25]), ("f", "1", days[0])], "event_id string, code string, t date")
    got = {x.event_id: x for x in bars.attach_before(e, bars.price_features(df), "t", bars.FEATURES).collect()}
    assert got["e"].adv20 == pytest.approx(np.mean([100.0 * (i + 1) for i in range(5, 25)])) and got["f"].adv20 is None
    changed = df.withColumn("amount", F.when(F.col("date") >= days[25], 1e12).otherwise(F.col("amount")))
    assert bars.attach_before(e, bars.price_features(changed), "t", ["adv20"]).where("event_id = 'e'").first().adv20 == got["e"].adv20
    with pytest.raises(ValueError):
        bars.price_features(df.drop("close"))


def test_fills_shift_and_block(spark):
    days = weekdays(40)
    closes = [10.0] * 40
    closes[10], closes[11] = 11.0, 11.0  # limit up on 10
    for i in range(12, 15):
        closes[i] = 11.0
    closes[15] = 9.9  # limit down on 15
    for i in range(16, 40):
        closes[i] = 10.5
    df = spark.createDataFrame([("600001", d, c) for d, c in zip(days, closes)], "code string, date date, close double")
    c = cal(spark)
    e = spark.createDataFrame([("a", "600001", days[10]), ("b", "600001", days[39]), ("c", "600002", days[3])], "event_id string, code string, t date")
    got = {x.event_id: x for x in fills.resolve_fills(e, fills.trade_grid(df, c, [4]), c, "t", [4]).collect()}
    assert (got["a"].entry_idx, got["a"].entry_shift, got["a"].exit_idx_4) == (11, 1, 16)
    assert got["a"].ret_4 == pytest.approx(10.5 / 11 - 1)
    assert (got["b"].entry_blocked, got["b"].exit_blocked_4) == (False, True)
    assert (got["c"].entry_blocked, got["c"].exit_blocked_4, got["c"].ret_4) == (True, False, None)


def test_surprise_ignores_the_future(spark):
    q = [date(2020, 3, 31), date(2020, 6, 30), date(2020, 9, 30), date(2020, 12, 31), date(2021, 3, 31), date(2021, 6, 30), date(2021, 9, 30), date(2021, 12, 31), date(2022, 3, 31), date(2022, 6, 30)]
    eps = [1.0, 1.2, 0.9, 1.4, 1.1, 1.5, 0.7, 1.9, 1.3, 2.0]
    df = spark.createDataFrame([("1", d, v) for d, v in zip(q, eps)] + [("2", d, 1.0) for d in q], "code string, report_date date, eps double")
    got = {(x.code, x.report_date): x.sue for x in signals.seasonal_surprise(df, lag=4, window=8, least=4).collect()}
    ue = [eps[i] - eps[i - 4] for i in range(4, 10)]
    assert got["1", q[8]] == pytest.approx(ue[4] / np.std(ue[:4], ddof=1)) and got["1", q[7]] is None and got["2", q[9]] is None
    later = df.withColumn("eps", F.when(F.col("report_date") == q[9], 99.0).otherwise(F.col("eps")))
    assert signals.seasonal_surprise(later).where(f"code = '1' AND report_date = DATE'{q[8]}'").first().sue == got["1", q[8]]
    with pytest.raises(ValueError):
        signals.seasonal_surprise(df, lag=0)
    with pytest.raises(NotImplementedError):
        signals.analyst_surprise(None)


def test_neutralize_equals_least_squares(spark):
    rng = np.random.default_rng(0)
    n = 120
    g = rng.choice(["a", "b", None], n)
    x, y = rng.normal(size=n), rng.normal(size=n)
    rows = [(i, "p", None if i % 17 == 0 else float(x[i]), float(y[i]), g[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "i int, p string, x double, y double, g string")
    got = {r.i: r.z for r in crosssection.neutralize(df, ["p"], "y", "x", "g", "z").collect()}
    ok = [i for i in range(n) if i % 17]
    design = np.array([[x[i], g[i] == "a", g[i] == "b", g[i] is None] for i in ok], float)
    want = y[ok] - design @ np.linalg.lstsq(design, y[ok], rcond=None)[0]
    assert np.allclose([got[i] for i in ok], want) and got[0] is None


def test_coefficients_and_regression(spark):
    rows = [(d, float(i), float(i * (1 if d == "u" else -1)), 1.0) for d in "uv" for i in range(8)]
    df = spark.createDataFrame(rows, "d string, a double, b double, c double")
    assert {x.d: round(x.ic, 9) for x in factor.ic_by(df, ["d"], "a", "b").collect()} == {"u": 1.0, "v": -1.0}
    assert [x.ic for x in factor.ic_by(df, ["d"], "a", "c").collect()] == [None, None]
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 0.5 + x @ [2.0, -1.0] + rng.normal(size=200) * 0.1
    fit = factor.regression(spark.createDataFrame([("k", float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "k string, a double, b double, y double"), ["k"], "y", ["a", "b"])
    got = {r.term: r for r in fit.collect()}
    design = np.c_[np.ones(200), x]
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    s2 = ((y - design @ beta) ** 2).sum() / 197
    t = beta / np.sqrt(s2 * np.diag(np.linalg.inv(design.T @ design)))
    assert np.allclose([got[c].coef for c in ("const", "a", "b")], beta) and np.allclose([got[c].t_stat for c in ("const", "a", "b")], t)
    assert factor.student_t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)


def capped(spark, rows, *args, **more):
    """Weights by name; rows are (portfolio, name, weight, group, cap, before)."""
    df = spark.createDataFrame(rows, "k int, n string, weight double, g string, cap double, before double")
    return {(x.k, x.n): x.weight for x in portfolio.apply_constraints(df, ["k"], "n", *args, **more).collect()}


def flat(w, n="abc"):
    return [round(w[1, c], 9) for c in n]


def test_constraints(spark):
    one = lambda weights, groups="xxy", caps=(None,) * 6, before=(None,) * 6: [(1, n, w, g, c, b) for n, w, g, c, b in zip("abcdef", weights, groups, caps, before)]
    assert flat(capped(spark, one([0.5, 0.3, 0.2]), 0.4)) == [0.4, 0.36, 0.24]
    assert flat(capped(spark, one([0.5, 0.3, 0.2]), 1.0, "g", 0.6)) == [0.375, 0.225, 0.4]
    assert flat(capped(spark, one([0.5, 0.3, 0.2]), 0.2)) == [round(1 / 3, 9)] * 3
    assert flat(capped(spark, one([0.6, -0.2, 0.4], caps=(0.3, None, None)), 1.0, name_caps=["cap"])) == [round(3 / 7, 9), 0.0, round(4 / 7, 9)]
    assert flat(capped(spark, one([1.0, 0.0, 0.0], before=(0.5, 0.5, 0.0)), 1.0, before="before", most_turnover=0.1)) == [0.6, 0.4, 0.0]
    assert flat(capped(spark, one([1.0, 0.0, 0.0], before=(2.0, 2.0, None)), 1.0, before="before", most_turnover=0.9)) == [1.0, 0.0, 0.0]
    assert flat(capped(spark, one([0.0, None, -1.0]), 0.4, "g", 0.5)) == [0.0, 0.0, 0.0]
    # groups at their cap leave the rest to names without a group
    assert flat(capped(spark, one([0.5, 0.4, 0.1], ("x", "y", None)), 1.0, "g", 0.2)) == [0.2, 0.2, 0.6]
    w = capped(spark, one([0.40, 0.25, 0.15, 0.10, 0.06, 0.04], "aabbcc", (0.3,) * 6, (1 / 6,) * 6), 0.35, "g", 0.5, ["cap"], "before", 0.2)
    assert sum(w.values()) == pytest.approx(1) and max(w.values()) <= 0.35 and w[1, "a"] + w[1, "b"] <= 0.5 + 1e-9
    assert sum(abs(x - 1 / 6) for x in w.values()) / 2 <= 0.2 + 1e-9


@pytest.mark.parametrize("small", [100, 50_000])
def test_caps_equal_water_filling(spark, monkeypatch, small):
    """Many names in one portfolio, against capping the greatest in turn; with 100 rows as the limit the large portfolio is split."""
    monkeypatch.setattr(portfolio, "hot_hashes", lambda df, keys: sequence.hot_hashes(df, keys, small))
    r = random.Random(3)
    rows = [(k, f"n{i}", r.expovariate(1) ** 3, None, None, None) for k, n in ((1, 300), (2, 7)) for i in range(n)]
    want = {}
    for k, cap in ((1, 0.05), (2, 0.05)):
        own = {n: w for kk, n, w, *_ in rows if kk == k}
        total, high = sum(own.values()), set()
        own = {n: w / total for n, w in own.items()}
        while True:
            rest = sum(w for n, w in own.items() if n not in high)
            f = (1 - cap * len(high)) / rest if rest > 1e-12 else 0.0
            more = {n for n, w in own.items() if n not in high and f * w > cap + 1e-12}
            if not more:
                break
            high |= more
        got = {n: cap if n in high else f * w for n, w in own.items()}
        want |= {(k, n): w / sum(got.values()) for n, w in got.items()}
    found = capped(spark, rows, 0.05)
    assert found.keys() == want.keys() and all(found[x] == pytest.approx(want[x], abs=1e-12) for x in want)


def test_side_costs(spark):
    b = spark.createDataFrame([("a", 1.0), ("b", None), ("c", -1.0), ("d", 2.0)], "k string, v double")
    s = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("e", 1.0)], "k string, v double")
    got = {x.k: x.cost for x in portfolio.side_costs(b, s, ["k"], "v").collect()}
    assert got["b"] is None and got["c"] is None
    assert got["a"] == pytest.approx(0.0011) and got["d"] == pytest.approx(0.0006) and got["e"] == pytest.approx(0.0008)


def test_mean_variance(spark):
    mu = spark.createDataFrame([("p", "a", 0.1), ("p", "b", 0.0), ("q", "a", None), ("q", "b", None), ("q", "c", None)], "k string, n string, expected double")
    cov = spark.createDataFrame([("p", "a", "a", 0.04), ("p", "b", "b", 0.04), ("q", "a", "a", 0.01), ("q", "b", "b", 0.02), ("q", "c", "c", 0.04), ("q", "a", "zz", 9.0)], "k string, i string, j string, cov double")
    got = {(x.k, x.n): x.weight for x in portfolio.mean_variance(mu, cov, "k", "n", aversion=1.0, most=0.8).collect()}
    assert got["p", "a"] == pytest.approx(0.8, abs=1e-4) and got["p", "b"] == pytest.approx(0.2, abs=1e-4)
    assert [got["q", n] for n in "abc"] == pytest.approx([4 / 7, 2 / 7, 1 / 7], abs=1e-3)  # least variance
    held = {x.n: x.weight for x in portfolio.mean_variance(mu.where("k = 'q'"), cov, "k", "n", least=0.3).collect()}
    assert held == pytest.approx({"a": 0.4, "b": 0.3, "c": 0.3}, abs=1e-3)


def test_turnover_and_weights(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "b", 1.0), (3, "c", 1.0)], "d int, n string, w double")
    assert {x.d: x.turnover for x in portfolio.turnover(df, "d", "n", "w").collect()} == {1: 0.5, 2: 0.5, 3: 1.0}


def test_hot_groups_give_the_same(spark, small_chunks, monkeypatch):
    r = random.Random(12)
    rows = [(f"e{i}", r.choice("hhhhab"), r.choice(["x", "y", None]), None if r.random() < 0.1 else round(r.gauss(0, 1), 1), None if r.random() < 0.1 else r.gauss(0, 1), date(2024, r.choice([1, 2, 2, 2]), 5), r.choice([1e6, 1e8, None]), 0.02, False) for i in range(160)]
    df = spark.createDataFrame(rows, "event_id string, k string, g string, v double, x double, tradable_date date, adv20 double, volatility_20d double, entry_blocked boolean").repartition(3)

    def all_of(hot):
        out = crosssection.enough(df, ["k"], "x", 5, hot)
        out = crosssection.zscore(crosssection.winsorize(out, ["k"], "v", "w", 0.1, 0.9, hot), ["k"], "w", "z", hot)
        out = crosssection.neutralize(crosssection.demean(out, ["k"], "g", "v", "d", hot), ["k"], "v", "x", "g", "n", hot=hot)
        return crosssection.average_rank(crosssection.quantile_bucket(out, ["k"], "v", 3, "b", hot), ["k"], "v", "r", hot)

    def near(a, b):
        return len(a) == len(b) > 0 and all(x == pytest.approx(y, abs=1e-9) if isinstance(x, float) and isinstance(y, float) else x == y for p, q in zip(a, b) for x, y in zip(p, q))

    many = sequence.hot_hashes(df, ["k"], 10)
    assert many and near(*[sorted((tuple(x) for x in all_of(h).select("event_id", "w", "z", "d", "n", "b", "r").collect())) for h in ([], many)])
    runs = [backtest.Scenario("a", "v", "x"), backtest.Scenario("b", "x", "v", 0.5)]
    found = []
    for small in (10, 50_000):
        for module in (backtest, factor):
            monkeypatch.setattr(module, "hot_hashes", lambda d, keys: sequence.hot_hashes(d, keys, small))  # noqa: B023
        told = backtest.cohorts(df, runs)
        found.append((sorted(tuple(x) for x in told.select("scenario", "cohort", "n", "k", "gross", "benchmark", "cost", "capacity", "adv_missing").collect()), sorted((tuple(x) for x in factor.ic_both(df, ["k"], "v", "x").collect())), sorted(tuple(x) for x in factor.quantile_returns(df, ["k"], "v", "x", 3).select("k", "bucket", "n", "median_ret").collect())))
    assert all(near(a, b) for a, b in zip(*found))


def test_backtest_cohorts(spark):
    rows = [(f"e{i}", date(2024, 1, 2), float(i), 0.01 * (i if i < 8 else 5), 1e12, 0.0, False) for i in range(10)]
    df = spark.createDataFrame(rows, "event_id string, tradable_date date, s double, r double, adv20 double, volatility_20d double, entry_blocked boolean")
    x = backtest.cohorts(df, [backtest.Scenario("a", "s", "r")]).first()
    assert (x.n, x.k) == (10, 2) and x.gross == pytest.approx(0.05) and x.benchmark == pytest.approx(0.038)
    assert x.commission == pytest.approx(0.0006) and x.tax == pytest.approx(0.0005)
    small, large = (backtest.cohorts(df, [backtest.Scenario("a", "s", "r", cost=backtest.CostModel(aum=a))]).first().cost for a in (1e9, 1e11))
    assert small < large


def test_thin_folds_are_left_out(spark):
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(20)]
    df = spark.createDataFrame([(d, f"{d}{i}") for d in days for i in range(5)], "d date, event_id string")
    assert len(models.folds(df, "d", 5)) == 3  # the first block alone is a fifth of all rows
    assert [r.train_rows for r in models.fold_table(df, "d", 5, 0, 0.0).orderBy("fold").collect()] == [20, 40, 60, 80]
    undated = df.unionByName(df.limit(100).withColumn("d", F.lit(None).cast("date")))
    assert [r.fold for r in models.fold_table(undated, "d", 5).orderBy("fold").collect()] == [3, 4]
    assert models.folds(df.where("false"), "d", 5) == []


def test_folds_leave_a_gap(spark):
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(20)]
    df = spark.createDataFrame([(d, f"{d}{i}") for d in days for i in range(5)], "d date, event_id string")
    got = models.folds(df, "d", 5, purge_days=2, least_share=0.0)
    assert len(got) == 4
    for train, test in got:
        assert (test.agg(F.min("d")).first()[0] - train.agg(F.max("d")).first()[0]).days > 2
    curve = spark.createDataFrame([(x, x * x) for x in map(float, np.linspace(-1, 1, 60))], "x double, y double").repartition(2)
    net = models.fit_net(curve, ["x"], "y", (16, 8), 60, 0.05)
    got = models.predict_net(spark.createDataFrame([(0.5,), (None,)], "x double"), net, ["x"]).collect()
    assert abs(got[0].prediction - 0.25) < 0.1 and got[1].prediction is None
    for wrong in (curve.withColumn("y", F.lit(float("nan"))), curve.where("false")):
        with pytest.raises(ValueError):
            models.fit_net(wrong, ["x"], "y")
    x, y = np.random.default_rng(1).normal(size=(5, 3)), np.arange(5.0)
    ws = [np.random.default_rng(2).normal(size=s) for s in ((3, 4), (4,), (4, 1), (1,))]
    loss = lambda w: ((models.Net(w).predict(x) - y) ** 2).sum()
    up = [w.copy() for w in ws]
    up[0][1, 2] += 1e-6
    assert (loss(up) - loss(ws)) / 1e-6 == pytest.approx(models.net_slope(ws, x, y)[0][1, 2], rel=1e-3, abs=1e-3)
    with pytest.raises(ValueError):
        models.feature_columns(df, ["fwd_ret_5"])


def test_event_panel(spark):
    from tidemark.plans import study

    filed = spark.createDataFrame([("1", date(2023, 12, 31), "甲"), ("2", date(2023, 12, 31), "ST乙"), ("3", date(2023, 12, 31), "丙"), ("4", date(2023, 12, 31), "丁")], "code string, report_date date, name string")
    told = spark.createDataFrame([("1", date(2023, 12, 31), date(2024, 1, 5)), ("2", date(2023, 12, 31), date(2024, 1, 6)), ("3", date(2023, 12, 31), date(2030, 1, 1)), ("5", date(2023, 12, 31), date(2024, 1, 5))], "code string, report_date date, actual_disclosure_date date")
    master = study.Master(spark.createDataFrame([(c, date(2020, 1, 1)) for c in "123"], "code string, list_date date"), spark.createDataFrame([], "code string, delist_date date"), spark.createDataFrame([], "code string, change_date date, name_before string, name_after string"))
    got = {x.event_id: x.tradable_date for x in study.event_panel(filed, told, cal(spark), master).collect()}
    assert got == {"1:2023-12-31": date(2024, 1, 8)}
    kept = study.event_panel(filed, told, cal(spark), master, flagged="keep")
    assert {x.event_id for x in kept.collect()} == {"1:2023-12-31", "2:2023-12-31"}
    assert study.unseen(kept, kept.where("code = '1'")).count() == 1
    x = study.coverage(filed, told).first()
    assert (x.filings, x.announcements, x.matched, x.match_rate) == (4, 4, 3, 0.75)
    with pytest.raises(ValueError):
        study.event_panel(filed, told, cal(spark), flagged="other")


def test_order_checks(spark):
    d = date(2024, 1, 2)
    asked = spark.createDataFrame([("a", d, "buy"), ("a", d, "sell"), ("b", d, "buy"), ("c", d, "sell"), ("d", d, "buy")], "code string, date date, side string")
    off = spark.createDataFrame([("b", d)], "code string, date date")
    moves = spark.createDataFrame([("a", d, True, False), ("c", d, False, True)], "code string, date date, hit_up boolean, hit_down boolean")
    got = {(x.code, x.side): x.reason for x in bars.order_checks(asked, off, moves).collect()}
    assert got == {("a", "buy"): "limit up", ("a", "sell"): None, ("b", "buy"): "suspended", ("c", "sell"): "limit down", ("d", "buy"): None}
    with pytest.raises(Exception, match="unknown side"):
        bars.order_checks(asked.withColumn("side", F.lit("x")), off, moves).collect()
    assert bars.first_present(asked.withColumn("e", F.lit(None).cast("double")), ["zz", "e", "side"]) == "side"
