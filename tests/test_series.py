import math
import random
from datetime import date, datetime, timedelta
from decimal import Decimal
from statistics import median

from pyspark.sql import functions as F

from tidemark.operators.grid import to_grid
from tidemark.operators.history import contents, depths, differing, history
from tidemark.operators.spikes import fits, implausible, outliers
from tidemark.operators.trailing import Days, Sessions, trailing_totals


def cal(spark, n=30):
    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(n + 20)]
    work = [d for d in days if d.weekday() < 5][:n]
    return spark.createDataFrame(list(zip(work, range(n))), "session_date date, session_idx int"), work


def test_trailing_totals_equal_brute_force(spark):
    sessions, work = cal(spark)
    r = random.Random(3)
    data = [("ab"[i % 2], d, None if r.random() < 0.1 else Decimal(r.randrange(10**6)) / 100) for i, d in enumerate(work) if r.random() < 0.6] + [("a", date(2024, 1, 6), Decimal("9.50")), (None, work[0], Decimal(1)), ("a", None, Decimal(1))]
    df = spark.createDataFrame(data, "e string, d date, m decimal(20,2)")
    got = trailing_totals(df, "e", "d", ["m"], [Days(7, "w"), Sessions(5, "s")], sessions).collect()
    assert got
    for x in got:
        own = [(d, m) for e, d, m in data if e == x.e and d is not None and m is not None]
        week = [m for d, m in own if x.d - timedelta(days=7) < d <= x.d]
        last = [d for d in work if d <= x.d][-5:]
        five = [m for d, m in own if d in last]
        assert (x.m_w, x.n_m_w, x.m_s, x.n_m_s) == (sum(week), len(week), sum(five), len(five))
    firsts = {e: min(d for ee, d, _ in data if ee == e and d) for e in "ab"}
    assert len(got) == sum((work[-1] - f).days + 1 for f in firsts.values())


def test_trailing_totals_of_nothing(spark):
    sessions, _ = cal(spark)
    df = spark.createDataFrame([], "e string, d date, m decimal(20,2)")
    assert trailing_totals(df, "e", "d", ["m"], [Days(7, "w")], sessions).count() == 0


def test_extreme_amounts_enter_and_leave(spark, tmp_path):
    """Amounts and returns that no decimal holds count in their windows and leave nothing behind."""
    from tidemark.plans import market

    sessions, work = cal(spark, 45)
    sessions.write.parquet(f"{tmp_path}/trade_calendar.parquet")
    rows = [(i, "000001", datetime(d.year, d.month, d.day, 10), 10.0, 1.0, 1e300 if i == 3 else 1e22 if i == 4 else 7.25, 1e13 if i == 5 else 0.5, datetime(2024, 6, 1)) for i, d in enumerate(work)]
    spark.createDataFrame(rows, "price_id bigint, code string, date timestamp_ntz, close double, volume double, amount double, pct_change double, loaded_ts timestamp_ntz").write.parquet(f"{tmp_path}/prices.parquet")
    got = {x.day: x for x in market.trailing(spark, str(tmp_path)).collect()}
    assert got[work[3]].amount_20s == 1e300 + 3 * 7.25 and math.isclose(got[work[5]].ret_20s, 1e11) and got[work[5]].n_ret_20s == 6
    for i in (40, 44):
        x = got[work[i]]
        assert x.amount_20s == 145.0 and math.isclose(x.ret_20s, 0.1) and abs(x.ret_std_20s) < 1e-9 and x.n_ret_20s == 20 and math.isclose(x.compound_20s, 1.005**20 - 1)
    few = {x.day: x for x in market.trailing(spark, str(tmp_path), market.WINDOWS[2:], True).collect()}
    assert sorted(few) == work and all(few[d].amount_20s == got[d].amount_20s for d in work)


def test_grid_equals_brute_force(spark, small_chunks):
    sessions, work = cal(spark, 12)
    r = random.Random(5)
    data = [("a", datetime(d.year, d.month, d.day, r.randrange(9, 16), r.randrange(60), r.randrange(60)), float(r.randrange(1, 50)), 1.0) for d in work for _ in range(r.choice([0, 1, 3]))]
    data += [("b", datetime(2024, 1, 3, 10), 5.0, 2.0), ("b", datetime(2024, 1, 3, 10), 5.0, 2.0), ("b", None, 1.0, 1.0), ("b", datetime(2024, 1, 8, 10), None, 1.0), ("b", datetime(2024, 1, 9, 12), 7.0, 1.0)]
    df = spark.createDataFrame(data, "code string, date timestamp_ntz, close double, volume double")
    got = {(x.code, x.session_date): x for x in to_grid(df, "code", "date", "close", "volume", sessions, small=4).collect()}
    for code in "ab":
        own = {}
        for c, t, v, _ in data:
            if c == code and t and v is not None:
                own[t] = max(v, own.get(t, v))
        times = sorted(own)
        span = [d for d in work if times[0].date() <= d <= times[-1].date()]
        assert sorted(d for c, d in got if c == code) == span
        for d in span:
            x, a, z = got[code, d], datetime(d.year, d.month, d.day), datetime(d.year, d.month, d.day) + timedelta(days=1)
            assert x.n_readings == sum(t.date() == d for t in times) and x.status == ("observed" if x.n_readings else "filled")
            held = total = 0.0
            for t, u in zip(times, [*times[1:], None]):
                u = u or datetime(t.year, t.month, t.day) + timedelta(days=1)
                w = max((min(u, z) - max(t, a)).total_seconds(), 0)
                held, total = held + w, total + w * own[t]
            assert math.isclose(x.coverage, held / 86400) and math.isclose(x.mean_value, total / held)
            assert x.last_value == own[[t for t in times if t < z][-1]]


def brute_flags(series, times, run):
    out = {(i, "limit") for i, v in series if v <= 0 or v > 1e6}
    for k in range(len(series)):
        a = b = k
        while a and series[a - 1][1] == series[k][1]:
            a -= 1
        while b + 1 < len(series) and series[b + 1][1] == series[k][1]:
            b += 1
        if b - a + 1 >= run:
            out.add((series[k][0], "stuck"))
    good = [(i, math.log(v)) for i, v in series if 0 < v <= 1e6]
    moves = [abs(y[1] - x[1]) for x, y in zip(good, good[1:])]
    lim = times * median(moves) if moves else 0
    off = lambda a, b, c, d: (a - b > lim and c - d > lim) or (a - b < -lim and c - d < -lim)
    for k in range(1, len(good) - 1):
        x = [g[1] for g in good]
        if off(x[k], x[k - 1], x[k], x[k + 1]):
            out.add((good[k][0], "spike"))
        if k + 2 < len(good) and off(x[k], x[k - 1], x[k + 1], x[k + 2]):
            out |= {(good[k][0], "spike"), (good[k + 1][0], "spike")}
    return out


def test_spikes_equal_brute_force(spark, monkeypatch):
    from tidemark.operators import sequence

    monkeypatch.setattr(sequence, "CHUNK_ROWS", 55)
    r = random.Random(11)
    data, want = [], set()
    for code, n in (("hot", 150), ("cold", 40), ("tiny", 2)):
        price, series = 20.0, []
        for k in range(n):
            price *= math.exp(r.gauss(0, 0.01))
            if k == 25:
                price *= 1.6  # a real move
            v = round(price, 2)
            if k in (13, 50, 51, 99, 100, 12):
                v = round(v * r.choice([0.3, 4.0]), 2)
            if k in (30, 31):
                v = round(v * 3, 2)
            if k in (35, 75):
                v = r.choice([-5.0, 0.0, 2e6])
            if 60 <= k <= 66:
                v = 33.33
            series.append((len(data) + k, v))
        data += [(code, datetime(2024, 1, 1) + timedelta(hours=i), i, v) for i, v in series]
        want |= brute_flags(series, 12.0, 6)
    data += [(None, datetime(2024, 1, 1), 900, 1.0), ("cold", None, 901, 1.0), ("cold", datetime(2024, 1, 2, 1, 1), 902, None), ("cold", datetime(2024, 1, 2, 1, 2), 903, float("nan"))]
    df = spark.createDataFrame(data, "code string, date timestamp_ntz, id bigint, v double")
    got = implausible(df, "code", ["date", "id"], "v", 0.0, 1e6, 12.0, 6, passes=3, small=50)
    assert {(x.id, x.reason) for x in got.where("strict").collect()} == want
    assert any(reason == "spike" for _, reason in want)


def brute_passes(values, theta, scale, passes=3, reach=4):
    """The pass in which each reading is taken out (0: level shift, None: neither), one reading at a time."""
    x, n, limit = [math.log(v) for v in values], len(values), 12 * scale
    expected = lambda before: theta * max(min(before, 3 * scale), -3 * scale) if before is not None else 0.0
    out, shift, large, new = [None] * n, [False] * n, [False] * n, [False] * n
    for turn in range(1, passes + 1):
        shift = [s or (turn > 1 and big and not a and not (t and new[t - 1]) and not new[t + 1 : t + 2] == [True]) for t, (s, big, a) in enumerate(zip(shift, large, new))]
        kept, r = [o is None for o in out], 1 if turn == 1 else reach

        def near(values, t, step):
            return next((values[u] for k in range(1, r + 1) if 0 <= (u := t + step * k) < n and values[u] is not None), None)  # noqa: B023

        k = [a if b else None for a, b in zip(x, kept)]
        d = [(0.0 if shift[t] else None if near(k, t, -1) is None else x[t] - near(k, t, -1)) if kept[t] else None for t in range(n)]
        d_1, d1 = [near(d, t, -1) for t in range(n)], [near(d, t, 1) for t in range(n)]
        only = lambda v: [a if b else None for a, b in zip(v, kept)]  # noqa: B023, E731
        d_2, d2 = [near(only(d_1), t, -1) for t in range(n)], [near(only(d1), t, 1) for t in range(n)]

        def beyond(change, before, sign):
            part = expected(before)
            return change is not None and sign * (change - part) + abs(part) > limit

        new = []
        for t in range(n):
            steps = {0: (d[t], d_1[t]), 1: (d1[t], d[t]), 2: (d2[t], d1[t]), -1: (d_1[t], d_2[t])}
            new.append(kept[t] and any(beyond(*steps[a], s) and beyond(*steps[b], -s) for a, b in ((0, 1), (0, 2), (-1, 1)) for s in (1, -1)))
        large = [kept[t] and d[t] is not None and abs(d[t] - expected(d_1[t])) > limit for t in range(n)]
        out = [turn if a else o for a, o in zip(new, out)]
    return [o or (0 if a or b else None) for o, a, b in zip(out, large, shift)]


def test_passes_equal_brute_force(spark, monkeypatch):
    from tidemark.operators import sequence

    monkeypatch.setattr(sequence, "CHUNK_ROWS", 60)
    r = random.Random(17)
    data, want = [], {}
    for code, n in (("hot", 400), ("cold", 120), ("tiny", 3)):
        price, move, values = 30.0, 0.0, []
        for k in range(n):
            move = -0.4 * move + r.gauss(0, 0.01)
            price *= math.exp(move) * (1.5 if k == n // 2 else 1.0)
            if k in (90, 91, 92):
                values.append(price * (2, 20, 20)[k - 90])
                continue
            values.append(price * (r.choice([0.4, 2.5, 3.0]) if r.random() < 0.06 or k in (55, 57, 58, 60, 61) else 1.0))
        d = [math.log(b / a) for a, b in zip(values, values[1:])]
        signs = [math.copysign(1, a) * math.copysign(1, b) for a, b in zip(d, d[1:]) if a * b]
        theta = math.sin(math.pi / 2 * sum(signs) / len(signs)) * len(signs) / (len(signs) + 30)
        found = brute_passes(values, theta, median(map(abs, d)))
        want |= {(code, k): v for k, v in enumerate(found) if v is not None}
        data += [(code, k, v) for k, v in enumerate(values)]
    df = spark.createDataFrame(data, "code string, i int, v double").repartition(3)
    got = outliers(df, "code", ["i"], "v", 12.0, small=150).collect()
    assert {(x.code, x.i): x.in_pass if x.kind == "outlier" else 0 for x in got} == want
    assert {1, 2} <= set(want.values()) and all(x.in_pass == 1 for x in got if x.strict)


def test_level_shift_is_no_outlier(spark):
    values = [10, 10.1, 10, 10.1, 10, 10.1, 20, 20.2, 20, 20.2, 20, 60, 20.1, 20]
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(values)], "code string, i int, v double")
    got = {x.i: (x.kind, x.in_pass) for x in outliers(df, "code", ["i"], "v", 12.0, passes=3).collect()}
    assert got == {11: ("outlier", 1), 6: ("level shift", 3)}
    assert outliers(df.where("false"), "code", ["i"], "v", 12.0).count() == 0


def test_fit_follows_the_reversals(spark):
    r = random.Random(1)
    d = [0.0]
    for _ in range(4000):
        d.append(-0.5 * d[-1] + r.gauss(0, 0.01))
    d[100::50] = [3.0] * len(d[100::50])  # spikes move neither figure
    df = spark.createDataFrame([("k", b, a) for a, b in zip(d, d[1:])], "code string, _d double, _d_1 double")
    x = fits(df, "code").first()
    assert abs(x._theta + 0.5) < 0.07 and abs(x._scale - 0.0078) < 0.001


def test_history_equals_brute_force(spark, small_chunks):
    r = random.Random(2)
    data = [(r.choice("hhhhab"), datetime(2024, 1, 1) + timedelta(hours=37 * i), r.choice(["x", "x", "x", "y", None])) for i in range(150)]
    df = spark.createDataFrame([*data, *data[:20], (None, data[0][1], "x"), ("a", None, "x")], "k string, at timestamp_ntz, v string")
    got = {(x.k, x.valid_from): (x.v, x.valid_to, x.current) for x in history(df, "k", "at", "v", "year(_at) * 12 + month(_at)", small=10).collect()}
    want = {}
    for k in "hab":
        starts = []
        for kk, t, v in data:
            if kk == k and v is not None and (not starts or starts[-1][1] != v):
                starts.append((t, v))
        for (t, v), after in zip(starts, [*starts[1:], None]):
            want[k, t] = (v, after and after[0], after is None)
    assert got == want
    assert history(df.where("false"), "k", "at", "v", "year(_at)").count() == 0


def test_equal_branches_are_left(spark):
    """Of a snapshot that repeats the last one no leaf is compared, of one with three changes three leaves at most."""
    rows = [(f"k{i}", m, f"v{i}{'x' if m >= 3 and i in (7, 77, 777) else ''}") for i in range(1000) for m in (1, 2, 3, 4) for _ in range(2)]
    df = spark.createDataFrame(rows, "k string, _period bigint, v string").select("_period", F.xxhash64("k").alias("_hash"), F.xxhash64("v").alias("_said"))
    content = contents(df)
    for levels in (depths(1000), depths(1000, 3), [1, 4, 5]):
        open_leaves = dict(differing(content, levels).groupBy("_period").count().collect())
        assert set(open_leaves) == {1, 3} and open_leaves[3] <= 3
    assert depths(0) == [2] and depths(10**9)[-1] == 31 and depths(1000) == [8, 11]


def test_two_values_in_one_snapshot(spark):
    """The same two values in each of two months are four versions, in whichever order they came."""
    at = lambda m, d: datetime(2024, m, d)
    data = [("k", at(1, 2), "x"), ("k", at(1, 3), "y"), ("k", at(2, 2), "x"), ("k", at(2, 3), "y"), ("k", at(3, 1), "y"), ("l", at(1, 1), "x"), ("l", at(3, 1), "x")]
    df = spark.createDataFrame(data, "k string, at timestamp_ntz, v string")
    got = {(x.k, x.valid_from) for x in history(df, "k", "at", "v", "month(_at)").collect()}
    assert got == {("k", at(1, 2)), ("k", at(1, 3)), ("k", at(2, 2)), ("k", at(2, 3)), ("l", at(1, 1))}
    told = spark.createDataFrame([("k", at(1, 2), "x", at(5, 1)), ("k", at(1, 2), "y", at(4, 1)), ("k", at(1, 3), "x", at(1, 3))], "k string, at timestamp_ntz, v string, told timestamp_ntz")
    assert [x.v for x in history(told, "k", "at", "v", "month(_at)", "told").collect()] == ["x"]


def test_clashing_columns_pass_through(spark):
    rows = [("k", i, 5.0, "mine", 1, 2.5) for i in range(7)]
    df = spark.createDataFrame(rows, "code string, i int, v double, reason string, _chunk int, _e double")
    got = implausible(df, "code", ["i"], "v", 0.0, 1e6, 12.0, 6).collect()
    assert {(x.i, x.reason, x._chunk, x._e) for x in got} == {(i, "stuck", 1, 2.5) for i in range(7)}
    assert implausible(df.where("false"), "code", ["i"], "v", 0.0, 1e6, 12.0, 6).count() == 0
