import random
from statistics import median

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import sequence as S


def rows(n=300, seed=1):
    r = random.Random(seed)
    return [("hot" if r.random() < 0.6 else r.choice("abc"), i, round(r.choice([0.0, -1.5, 2.25, r.uniform(-9, 9)]), 3)) for i in range(n)]


def test_positions_are_exact_within_each_key(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, i int, v double")
    got = {(x.k, x.i): x._pos for x in S.positions(df, ["k"], [F.col("v").desc(), F.col("i")]).collect()}
    for k in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == k), key=lambda d: (-d[2], d[1]))
        assert [got[k, d[1]] for d in own] == list(range(len(own)))


def test_positions_with_null_key_and_empty(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, i int")
    assert sorted(x._pos for x in S.positions(df, ["k"], [F.col("i")]).collect()) == [0, 0, 1]
    assert S.positions(df.where("i > 9"), ["k"], [F.col("i")]).count() == 0


def test_chunks_give_the_same_windows(spark, small_chunks):
    df = spark.createDataFrame(rows(), "k string, i int, v double")
    order = [F.col("i")]
    plain = Window.partitionBy("k").orderBy("i")
    for halo in (1, 3, 5):
        cut = S.chunked(df, ["k"], order, halo, small=20)
        w = S.chunk_window(["k"], order)
        got = cut.withColumn("a", F.lag("v", halo).over(w)).withColumn("b", F.lead("v", halo).over(w)).where("_own").select("k", "i", "a", "b")
        want = df.withColumn("a", F.lag("v", halo).over(plain)).withColumn("b", F.lead("v", halo).over(plain)).select("k", "i", "a", "b")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert cut.where("_own").select("k", "_chunk").distinct().count() > 10


def test_runs_across_chunks(spark, small_chunks):
    values = [1.0] * 5 + [2.0] * 6 + [None] * 7 + [3.0] * 30 + [1.0, 2.0] * 4
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i int, v double")
    cut = S.chunked(df, ["k"], [F.col("i")], 5, small=10)
    got = sorted(x.i for x in cut.withColumn("r", S.in_run(["v"], 6, S.chunk_window(["k"], [F.col("i")]))).where("_own AND r").collect())
    assert got == [i for i in range(5, 11)] + [i for i in range(18, 48)]


def test_exact_median_and_quantiles(spark):
    data = rows(401, 7) + [("one", 1, 4.0), ("two", 1, 1.0), ("two", 2, -2.0), ("none", 1, None)]
    df = spark.createDataFrame(data, "k string, i int, v double")
    by = {}
    for k, _, v in data:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert {x.k: x.m for x in S.exact_median(df, ["k"], "v", "m").collect()} == {k: median(v) for k, v in by.items()}
    probs = [0, 0.01, 0.2, 0.5, 0.95, 1]
    for x in S.exact_quantiles(df, ["k"], "v", probs, "q").collect():
        assert np.allclose(x.q, np.quantile(by[x.k], probs))


def test_positions_of_a_key_with_any_name(spark):
    for name in ("_all", "_here", "_key0"):
        df = spark.createDataFrame([("a", i) for i in range(20)] + [(None, 3)], f"`{name}` string, i int").repartition(3)
        assert sorted((x.i, x.p) for x in S.positions(df, [name], [F.col("i")], "p").where(f"`{name}` IS NOT NULL").collect()) == [(i, i) for i in range(20)]


def test_keys_beyond_the_bound_stay_whole(spark, small_chunks, monkeypatch):
    """More large keys than are split: the others are sorted in one place, and no row is lost."""
    monkeypatch.setattr(S, "HOT_PER_PARTITION", 1)  # four of the nine with the tests' partitions
    rows = [(f"k{k}", i) for k in range(9) for i in range(20 + k)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(3)
    hot = S.hot_hashes(df, ["k"], 10)
    assert len(hot) == S.shuffle_parts(spark) < 9
    cut = S.chunked(df, ["k"], [F.col("i")], 1, 10)
    got = cut.withColumn("p", F.lag("i").over(S.chunk_window(["k"], [F.col("i")]))).where("_own").select("k", "i", "p").collect()
    assert sorted((x.k, x.i, x.p) for x in got if x.i) == sorted((k, i, i - 1) for k, i in rows if i) and len(got) == len(rows)
