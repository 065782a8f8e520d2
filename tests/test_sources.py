import duckdb
import pandas as pd
import pytest
from datetime import date

from tidemark.plans import raw, registry
from tidemark.sources import cache, files, vendors
from tidemark.streaming import commits


def test_cache_round_trip(spark, tmp_path):
    calls = []

    def call(**params):
        calls.append(params)
        if len(calls) == 1:
            raise OSError("down")
        return pd.DataFrame({"a": [1, "x", None], "b": [1.0, 2.0, 3.0]})

    waits = []
    store = cache.Store(spark, str(tmp_path), sleep=waits.append)
    get = lambda **k: store.get("bars", {"code": "1"}, call, **k)
    assert [r.a for r in get().orderBy("b").collect()] == ["1", "x", None] and len(calls) == 2 and waits == [1.5]
    get()
    assert len(calls) == 2
    get(force=True)
    assert len(calls) == 3
    (tmp_path / "_notes" / "broken.json").write_text("{")
    listed = store.listing().collect()
    assert [(r.interface, r.params, r.rows, r.columns) for r in listed] == [("bars", '{"code": "1"}', 3, ["a", "b"])]
    assert cache.Store(spark, str(tmp_path / "none")).listing().count() == 0
    with pytest.raises(cache.SourceError):
        store.get("other")

    def down(**params):
        raise OSError("down")

    waits.clear()
    with pytest.raises(cache.SourceError, match="down"):
        store.get("gone", call=down)
    assert waits == [1.5, 1.5**2, 1.5**3]
    a, b, c = (cache.Request(i, p).name for i, p in (("a", {"x": 1, "y": 2}), ("a", {"y": 2, "x": 1}), ("b", {"x": 1, "y": 2})))
    assert a == b != c and len(cache.Request("a", {"x": "long " * 50}).name) <= 73
    assert store.get("none", call=lambda: pd.DataFrame({"a": [None], "b": [True]})).first().asDict() == {"a": None, "b": True}


def test_fallback_breaker_bulk(spark):
    def down():
        raise cache.SourceError("no")

    breakers = [cache.Breaker(2), cache.Breaker()]
    for _ in range(3):
        assert cache.fallback([down, lambda: "ok"], breakers) == "ok"
    assert breakers[0].open and not breakers[1].open
    with pytest.raises(cache.SourceError):
        cache.fallback([down])
    got, failed = cache.bulk(spark, ["1", "2", "1"], lambda c: spark.createDataFrame([(c,)], "c string") if c == "1" else down())
    assert [r.c for r in got.collect()] == ["1"] and [r.code for r in failed.collect()] == ["2"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    files.save_panel(df, str(tmp_path / "p"))
    assert files.load_panel(spark, str(tmp_path / "p")).count() == 2
    with pytest.raises(FileNotFoundError):
        files.load_panel(spark, str(tmp_path / "q"))
    files.save_csv(df, str(tmp_path / "c"))
    assert sorted(files.load_csv(spark, str(tmp_path / "c"), "k string, v double").collect()) == sorted(df.collect())
    assert files.load_csv(spark, str(tmp_path / "none"), "k string") is None
    files.save_json(spark, files.Settings(), str(tmp_path / "s.json"))
    files.save_json(spark, files.Settings(), str(tmp_path / "s.json"))
    assert files.load_json(spark, str(tmp_path / "s.json"))["lag"] == 4 and files.load_json(spark, str(tmp_path / "x.json")) is None
    assert files.Settings().fingerprint() == files.Settings().fingerprint() != files.Settings(lag=1).fingerprint()
    assert files.markdown_table(["a"], [("x|y",), (None,)]).splitlines()[2] == "| x\\|y |"


def test_vendor_tables(spark):
    raw = spark.createDataFrame([("1", "甲", "1,000.5", "--", "2024-03-01"), ("1", "乙", "2", "3", None)], "`股票代码` string, `股票简称` string, `营业总收入-营业总收入` string, `每股收益` string, `实际披露时间` string")
    x = vendors.financials(raw, "2023-12-31").collect()
    assert len(x) == 1 and x[0].code == "000001" and x[0].roe is None and x[0].report_date == date(2023, 12, 31)
    told = vendors.announcements(raw, "2023-12-31")
    assert [(r.ann_ts, r.schedule_changes) for r in told.collect()] == [(date(2024, 3, 1), 0)]
    assert vendors.attach_disclosure(vendors.financials(raw, "2023-12-31"), told).count() == 1
    with pytest.raises(ValueError):
        vendors.announcements(raw.drop("实际披露时间"), "2023-12-31")
    b = vendors.bars_b(spark.createDataFrame([("2024-01-02", "10", "0.01"), ("2024-01-03", None, "0.02"), ("2024-01-04", "12", "0.03")], "date string, close string, turnover string"), "600001")
    assert [(r.pct_change and round(r.pct_change, 9), round(r.turnover, 9)) for r in b.orderBy("date").collect()] == [(None, 1.0), (0.0, 2.0), (20.0, 3.0)]
    a = vendors.bars_a(spark.createDataFrame([("2024-01-02", "9")], "`日期` string, `收盘` string"), "600001")
    both = vendors.bars_with_fallback(a, b)
    assert sorted((str(r.date), r.source) for r in both.collect()) == [("2024-01-02", "a"), ("2024-01-03", "b"), ("2024-01-04", "b")]
    acts = vendors.corporate_actions(spark.createDataFrame([("1", "2024-05-01", 5.0, 10.0), ("2", "2024-05-01", None, 1.0), ("3", None, 1.0, 1.0)], "`代码` string, `除权除息日` string, `现金分红-现金分红比例` double, `送转股份-送转总比例` double"), "2023-12-31")
    assert {(r.code, r.cash_dividend_per_share, r.share_ratio, r.type) for r in acts.collect()} == {("000001", 0.5, 1.0, "送转+分红"), ("000002", 0.0, 0.1, "送转")}
    sh = spark.createDataFrame([("1", "甲", "2000-01-01")], "`证券代码` string, `证券简称` string, `上市日期` string")
    sz = spark.createDataFrame([("1", "乙", "2001-01-01"), ("2", "丙", None), ("3", "丁", "20020101")], "`A股代码` string, `A股简称` string, `A股上市日期` string")
    assert {(r.code, r.name, str(r.list_date)) for r in vendors.listings([(sh, "主板")], sz).collect()} == {("000001", "甲", "2000-01-01"), ("000003", "丁", "2002-01-01")}


def test_commits_are_ordered_and_exactly_once(spark, tmp_path):
    schema = "account string, session_idx int, amount double, payload string"
    for n, rows in enumerate(([("a", 1, 5.0, "x"), ("a", 2, 1.0, "y"), ("b", 7, 2.0, "z")], [("a", 2, 1.0, "y"), ("a", 3, 4.0, "w"), ("b", 9, 1.0, "q")], [("a", 3, 4.0, "changed"), ("a", 0, 1.0, "old"), ("b", 8, 1.0, "r")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={n}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "batch=*"))
        done = commits.commits(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert done.awaitTermination(120)
    got = sorted((r.account, r.session_idx, r.status, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted([("a", 1, "applied", ""), ("a", 2, "applied", ""), ("b", 7, "applied", ""), ("a", 2, "duplicate", ""), ("a", 3, "applied", ""), ("b", 9, "rejected", "gap"), ("a", 3, "rejected", "changed content"), ("a", 0, "rejected", "out of order"), ("b", 8, "applied", "")])
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert {(r.account, r.sessions, r.gaps, r.changed) for r in commits.contiguous(batch).collect()} == {("a", 4, 0, 1), ("b", 3, 0, 0)}


def committed(spark, folder):
    return sorted(tuple(r) for r in raw.account_commits(spark, str(folder)).select("account", "session_idx", "status", "reason", "balance").collect())


def test_account_commits_read_a_table_of_many_files(spark, tmp_path):
    """A file, a folder of files and a folder without rows: the same commits as by SQL."""
    rows = [(run, f"{2020 + m // 12}-{m % 12 + 1:02d}", m / 8) for run, months in ((1, range(30)), (2, [5, 6, 9, 10]), (3, [0])) for m in months]
    table = spark.createDataFrame(rows, "run_id int, cohort string, gross_return double")
    table.repartition(5).write.parquet(str(tmp_path / "many" / "backtest_cohorts.parquet"))
    table.coalesce(1).write.parquet(str(tmp_path / "one" / "made"))
    next((tmp_path / "one" / "made").glob("part-*")).rename(tmp_path / "one" / "backtest_cohorts.parquet")
    table.where("run_id = 0").write.parquet(str(tmp_path / "none" / "backtest_cohorts.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW backtest_cohorts AS SELECT * FROM '{tmp_path}/one/backtest_cohorts.parquet'")
    want = sorted(db.execute(f"SELECT account, session_idx, status, reason, balance FROM ({registry.SQL['account_commits']})").fetchall())
    assert len(want) == len(rows) and committed(spark, tmp_path / "many") == want and committed(spark, tmp_path / "one") == want
    assert committed(spark, tmp_path / "none") == []


def test_account_commits_of_accounts_over_several_arrow_batches(spark, tmp_path):
    """Spark hands an account's snapshots over in pieces of the Arrow batches, in no order."""
    rows = [(run, f"{2000 + m // 12}-{m % 12 + 1:02d}", 1.0) for m in reversed(range(40)) for run in range(3)]
    spark.createDataFrame(rows, "run_id int, cohort string, gross_return double").repartition(3).write.parquet(str(tmp_path / "backtest_cohorts.parquet"))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = committed(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got == sorted((str(run), 24_001 + m, "applied", "", m + 1.0) for run in range(3) for m in range(40))


def test_account_commits_round_halves_as_sql(spark, tmp_path):
    """Amounts at a half of the sixth digit, exactly and all but."""
    halves = [k * 1e-6 + n / 1e7 for k in range(0, 4_000, 7) for n in (-5, 5, 15)]
    rows = [(n, "2020-01", x) for n, x in enumerate(halves)]
    spark.createDataFrame(rows, "run_id int, cohort string, gross_return double").coalesce(1).write.parquet(str(tmp_path / "backtest_cohorts.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW backtest_cohorts AS SELECT * FROM '{tmp_path}/backtest_cohorts.parquet/*.parquet'")
    want = sorted(db.execute(f"SELECT account, session_idx, status, reason, balance FROM ({registry.SQL['account_commits']})").fetchall())
    assert committed(spark, tmp_path) == want


def test_commits_in_shared_states_go_on_after_a_restart(spark, tmp_path, monkeypatch):
    """Accounts of one bucket keep their own sessions, contents and balances, and only the digests of the last sessions."""
    monkeypatch.setattr(commits, "KEPT", 3)

    class State:
        exists = False

        def update(self, value):
            self.exists, self.get = True, value

    def batch(state, rows):
        rows = [(a, s, bytes([c]) * commits.WIDTH, 1.0) for a, s, c in rows]
        (made,) = commits.fold((0,), iter([pd.DataFrame(rows, columns=["account", "session_idx", "digest", "amount"])]), state)
        return list(made[["account", "session_idx", "status", "reason", "balance"]].itertuples(index=False, name=None))

    state = State()
    assert batch(state, [("b", 7, 1), *[("a", s, s) for s in (4, 2, 5, 3, 1)]]) == [*[("a", s, "applied", "", float(s)) for s in range(1, 6)], ("b", 7, "applied", "", 1.0)]
    assert batch(state, [("a", 3, 3), ("a", 4, 9), ("a", 2, 2), ("b", 8, 1), ("c", 1, 1)]) == [("a", 2, "rejected", "out of order", 5.0), ("a", 3, "duplicate", "", 5.0), ("a", 4, "rejected", "changed content", 5.0), ("b", 8, "applied", "", 2.0), ("c", 1, "applied", "", 1.0)]
    assert batch(state, [("a", 8, 8), ("a", 6, 6), ("b", 9, 2)]) == [("a", 6, "applied", "", 6.0), ("a", 8, "rejected", "gap", 6.0), ("b", 9, "applied", "", 3.0)]
