import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark.operators import validity as V


def world(seed, n=60):
    r = random.Random(seed)
    day = lambda k: date(2024, 1, 1) + timedelta(days=k)
    pick = lambda x: None if r.random() < 0.05 else x
    facts = [(r.choice("hhhhab"), pick(day(r.randrange(40))), pick(r.randrange(1, 400)), pick(i)) for i in range(n)]
    events = [(f"e{i}", r.choice("hhhabz"), pick(day(r.randrange(-3, 45))), pick(r.randrange(0, 420))) for i in range(n)]
    return facts, events


def test_as_known_equals_brute_force(spark, small_chunks):
    for seed in range(3):
        facts, events = world(seed)
        f = spark.createDataFrame(facts, "k string, stated date, known bigint, row bigint")
        e = spark.createDataFrame(events, "event_id string, k string, d date, at bigint")
        got = {(x.event_id): x.row for x in V.as_known(e, f, ["k"], "at", "known", "row", "d", "stated", small=5).collect()}
        want = {}
        for i, k, d, at in events:
            able = [(s, t, v) for kk, s, t, v in facts if kk == k and None not in (s, t, v, d, at) and s <= d and t <= at]
            if able:
                want[i] = max(able)[2]
        assert got == want
        got = {x.event_id: x.row for x in V.as_known(e.drop("d"), f.drop("stated"), ["k"], "at", "known", "row", small=5).collect()}
        want = {}
        for i, k, _, at in events:
            able = [(t, v) for kk, _, t, v in facts if kk == k and None not in (t, v, at) and t <= at]
            if able:
                want[i] = max(able)[1]
        assert got == want


def test_steps_cover_each_point_once():
    r = random.Random(5)
    for n in (0, 1, 2, 3, 5, 8, 13, 60):
        for order in (sorted, lambda k: sorted(k, reverse=True), list):
            s, k = sorted(r.sample(range(200), n)), order([r.randrange(40) for _ in range(n)])
            found = list(V.steps(s, k))
            assert len(found) <= 2 * n
            for d in range(-1, 201, 3):
                for t in range(-1, 42):
                    inside = [a for kf, kt, a, z in found if kf <= t and (kt is None or t < kt) and a <= d and (z is None or d < z)]
                    able = [x for x, y in zip(s, k) if x <= d and y <= t]
                    assert inside == ([max(able)] if able else [])
    long = list(V.steps(list(range(20_000)), list(range(20_000))))  # quadratic work wouldn't end
    assert len(long) == 2 * 20_000 - 1


def test_few_looks_per_event(spark):
    """However lengths differ, an event looks into a bucket per power of 16."""
    r = random.Random(6)
    facts, at = [], 0
    for i in range(400):
        facts.append(("k", at, i))
        at += r.choice([1, 10, 1000, 10**6, 10**9])
    f = spark.createDataFrame(facts, "k string, since bigint, i int")
    e = spark.createDataFrame([("k", r.randrange(-5, at + 10)) for _ in range(300)], "k string, at bigint")
    got = V.interval_join(e, V.versions(f, ["k"], "since"), ["k"], [("at", "since", "_until")]).collect()
    assert {(x["at"], x.i) for x in got} == {(t.at, max(i for _, s, i in facts if s <= t.at)) for t in e.collect() if t.at >= 0}


def test_empty_sides(spark):
    f = spark.createDataFrame([], "k string, stated date, known bigint, row bigint")
    e = spark.createDataFrame([("e", "k", date(2024, 1, 1), 5)], "event_id string, k string, d date, at bigint")
    assert V.as_known(e, f, ["k"], "at", "known", "row", "d", "stated").count() == 0
    g = spark.createDataFrame([("k", date(2024, 1, 1), 1, 7)], "k string, stated date, known bigint, row bigint")
    assert V.as_known(e.where("false"), g, ["k"], "at", "known", "row", "d", "stated").count() == 0


def test_later_facts_never_matter(spark):
    f = spark.createDataFrame([("k", 10, 1)], "k string, known bigint, row bigint")
    e = spark.createDataFrame([("e", "k", 20)], "event_id string, k string, at bigint")
    later = f.unionByName(f.select("k", F.lit(21).cast("bigint").alias("known"), F.lit(2).cast("bigint").alias("row")))
    a, b = (V.as_known(e, x, ["k"], "at", "known", "row").first().row for x in (f, later))
    assert a == b == 1


def test_bounds_are_half_open(spark):
    f = spark.createDataFrame([("k", 10, 1), ("k", 20, 2)], "k string, known bigint, row bigint")
    e = spark.createDataFrame([("a", "k", 9), ("b", "k", 10), ("c", "k", 19), ("d", "k", 20)], "event_id string, k string, at bigint")
    assert {x.event_id: x.row for x in V.as_known(e, f, ["k"], "at", "known", "row").collect()} == {"b": 1, "c": 1, "d": 2}


def test_clashing_columns_give_way(spark):
    f = spark.createDataFrame([("k", 10, 1, "fact")], "k string, known bigint, row bigint, note string").withColumn("_event", F.lit(1))
    e = spark.createDataFrame([("e", "k", 20, 99, "event", 5)], "event_id string, k string, at bigint, row bigint, note string, _known int")
    x = V.as_known(e, f, ["k"], "at", "known", "row").first()
    assert (x.event_id, x.row, x.note, x._known) == ("e", 1, "event", 5)
