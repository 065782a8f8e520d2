"""Attributes as known at event time: validity intervals exploded into time buckets and equi-joined with half-open containment.

The width of an interval's bucket is its length rounded down to a power of 16, so it lies in 17 buckets at most, and in one bucket
lie few intervals of a key that follow each other. An event looks into one bucket of each width in use, of which there are as
many as powers of 16 between the shortest and the longest interval. An interval in two times (known, stated) is bucketed in
the one in which it is narrower, and the other one is tested by containment.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sequence import SMALL_KEY, chunk_window, chunked, hot_hashes, replicated, salted
from tidemark.session import settle


def versions(facts: DataFrame, keys: list[str], since: str, until: str = "_until", small: int = SMALL_KEY, hot: list[int] | None = None) -> DataFrame:
    """Half-open validity [since, until) of successive facts of a key; the last one is open (NULL). ``since`` must be unique in its key."""
    cut = chunked(facts, keys, [F.col(since)], 1, small, hot=hot)
    return cut.withColumn(until, F.lead(since).over(chunk_window(keys, [F.col(since)]))).where("_own").drop("_chunk", "_own")


#: Bits by which a width of buckets exceeds the next smaller one.
WIDTH_BITS = 4


def interval_join(events: DataFrame, facts: DataFrame, keys: list[str], dims: list[tuple[str, str, str]], small: int = SMALL_KEY) -> DataFrame:
    """Inner join of events with the facts of the same keys whose intervals contain the event in every dimension.

    ``dims`` holds (event column, from column, to column), all BIGINT; an interval is [from, to), ``to`` NULL means open.
    Rows with a NULL key, event position or ``from`` match nothing. The names of the two sides must differ apart from the keys.
    Both sides are read more than once. Events of keys with more than ``small`` of them are spread by a salt, as wide
    buckets hold many of a key's events.
    """
    points = events.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, *[d[0] for d in dims]]))
    spread = points.agg(F.count(F.lit(1)), *[f(d[0]) for d in dims for f in (F.min, F.max)]).first()
    many, ends = spread[0], list(zip(spread[1::2], spread[2::2]))
    spans = facts.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, *[d[1] for d in dims]]))
    shares = []
    for i, (_, start, stop) in enumerate(dims):
        first, last = (int(x) for x in (ends[i] if many else (0, 0)))
        spans = spans.withColumn(f"_to{i}", F.least(F.coalesce(stop, F.lit(last + 1)), F.lit(last + 1).cast("bigint"))).where((F.col(f"_to{i}") > F.col(start)) & (F.col(f"_to{i}") > first))
        shares.append((F.col(f"_to{i}") - F.greatest(F.col(start), F.lit(first))) / (last - first + 1))
    narrow = F.array_position(F.array(*shares), F.array_min(F.array(*shares))) - 1
    spans = spans.withColumn("_dim", narrow.cast("int"))
    chosen = lambda columns: F.get(F.array(*columns), F.col("_dim"))
    lows = [F.greatest(F.col(start), F.lit(int(ends[i][0] if many else 0))) for i, (_, start, _) in enumerate(dims)]
    spans = spans.withColumn("_low", chosen(lows)).withColumn("_high", chosen([F.col(f"_to{i}") for i in range(len(dims))]))
    level = F.floor(F.log2((F.col("_high") - F.col("_low")).cast("double") * (1 + 1e-9)) / WIDTH_BITS) * WIDTH_BITS
    spans = spans.withColumn("_level", F.greatest(level, F.lit(0)).cast("int"))
    used = sorted((r["_dim"], r["_level"]) for r in spans.select("_dim", "_level").distinct().collect())  # 16 widths per dimension at most
    cell = lambda at: F.call_function("shiftright", at.cast("bigint"), F.col("_level"))
    spans = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col("_low")), cell(F.col("_high") - 1)))).drop("_low", "_high")
    looks = F.array(*[F.struct(F.lit(d).alias("_dim"), F.lit(v).alias("_level")) for d, v in used or [(0, 0)]])
    points = points.withColumn("_look", F.explode(looks)).select("*", "_look.*").drop("_look")
    points = points.withColumn("_cell", cell(chosen([F.col(at) for at, _, _ in dims])))
    hot = hot_hashes(events, keys, small) if many > small else []
    cells = ["_dim", "_level", "_cell"]
    joined = salted(points, keys, hot).join(replicated(spans, keys, hot), [*keys, *cells, "_salt"])
    for i, (at, start, _) in enumerate(dims):
        joined = joined.where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(f"_to{i}")))
    return joined.drop("_salt", *cells, *[f"_to{i}" for i in range(len(dims))])


def steps(stated: list[int], known: list[int]) -> Iterator[tuple[int, int | None, int, int | None]]:
    """Rectangles (known from, known to, stated from, stated to) in which each statement is the latest one known.

    ``stated`` rises; ``known`` is when each became known. As knowledge grows, a statement's reach ends at ever nearer later
    statements. From the last statement back, a stack holds those that can still bound an earlier one: the nearest, and
    behind each the next one known sooner. What is known later than a statement bounds it in turn and then is hidden by
    it, so that there are at most twice as many rectangles as statements.
    """
    stack: list[int] = []
    for i in range(len(stated) - 1, -1, -1):
        until = None
        while stack and known[stack[-1]] > known[i]:
            j = stack.pop()
            if until is None or known[j] < until:
                yield known[j], until, stated[i], stated[j]
                until = known[j]
        yield known[i], until, stated[i], stated[stack[-1]] if stack else None
        stack.append(i)


def latest_known(statements: DataFrame, keys: list[str], stated: str, known: str) -> DataFrame:
    """Validity of statements in two times: the rectangles (_known_from, _known_to) x (_stated_from, _stated_to) in which ``stated`` is the latest.

    ``stated`` is a DATE, so after taking the first ``known`` (BIGINT) of each date a key holds at most one row per day
    of the calendar, however many rows it has; only these are gathered per key, and each is passed once.
    """
    first = statements.where(F.col(stated).isNotNull() & F.col(known).isNotNull()).groupBy(*keys, F.unix_date(stated).alias("_s")).agg(F.min(known).alias("_k"))
    lists = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_s", "_k"))).alias("_list"))
    fields = [lists.schema[k] for k in keys]
    names = ["_known_from", "_known_to", "_stated_from", "_stated_to"]
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{n} bigint" for n in names])

    def rectangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, pairs in enumerate(batch.column("_list").to_pylist()):
                own = list(steps([p["_s"] for p in pairs], [p["_k"] for p in pairs]))
                found += own
                rows += [row] * len(own)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], *[pa.array([f[i] for f in found], pa.int64()) for i in range(4)]], names=[*keys, *names])

    return lists.mapInArrow(rectangles, out)


def as_known(events: DataFrame, facts: DataFrame, keys: list[str], at: str, known: str, value: str, stated_at: str | None = None, stated: str | None = None, small: int = SMALL_KEY) -> DataFrame:
    """For each event the fact of its keys that was the latest one known at ``at``: the event's columns and ``value``.

    Without ``stated`` it is the fact with the greatest ``known`` <= ``at``; with it, the one with the greatest
    ``stated`` <= ``stated_at`` of those known by then, and of these the latest known. Facts with a NULL ``known``,
    ``stated`` or ``value`` say nothing; of facts equal in all times the greatest ``value`` holds. Events without a
    matching fact, or with NULL times, have no row. Further columns of the facts are not read, and an event's column with the
    name of ``value`` gives way to it. ``at`` and ``known`` are BIGINT microseconds, the stated times DATE.
    """
    ids = [f"_key{i}" for i in range(len(keys))]
    named = lambda df: [F.col(k).alias(i) for k, i in zip(keys, ids)]
    day = F.unix_date(stated_at).cast("bigint") if stated is not None else F.lit(None).cast("bigint")
    asked = settle(events.select(F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("_event"), *named(events), F.col(at).cast("bigint").alias("_at"), day.alias("_at_day")))  # read for its span and by the join
    said = facts.select(*named(facts), F.col(known).cast("bigint").alias("_known"), (F.col(stated) if stated is not None else F.lit(None)).cast("date").alias("_stated"), F.col(value).alias("_value")).where("_value IS NOT NULL AND _known IS NOT NULL")
    if stated is None:
        unique = said.groupBy(*ids, "_known").agg(F.max("_value").alias("_value"))
        found = interval_join(asked, settle(versions(unique, ids, "_known", small=small)), ids, [("_at", "_known", "_until")], small)
    else:
        best = interval_join(asked, settle(latest_known(said, ids, "_stated", "_known")), ids, [("_at", "_known_from", "_known_to"), ("_at_day", "_stated_from", "_stated_to")], small)
        best = settle(best.select("_event", *ids, "_at", F.col("_stated_from").alias("_day")))
        unique = said.groupBy(*ids, F.unix_date("_stated").cast("bigint").alias("_day"), "_known").agg(F.max("_value").alias("_value"))
        inner = [*ids, "_day"]
        found = interval_join(best, settle(versions(unique, inner, "_known", small=small)), inner, [("_at", "_known", "_until")], small)
    return found.select(*[F.col("_event").getField(c).alias(c) for c in events.columns if c != value], F.col("_value").alias(value))
