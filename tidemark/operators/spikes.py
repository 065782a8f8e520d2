"""Implausible spikes in measurements: robust autoregression per source with outlier and level-shift tests, stuck runs, physical limits.

The changes d of a measurement's logarithm follow d[t] = theta * d[t-1] + e[t] per source, an autoregression with a unit root.
theta comes from the signs of successive changes (their quadrant correlation, shrunk to 0 where a source has few), and the
scale is the median absolute change; neither can be moved by spikes. A large residual that the next one or two
reverse is an additive outlier of one or two readings; a large one that nothing reverses is a level shift, a real move. The
change before counts in a residual with at most BOUND scales, so that a spike doesn't foretell its own end, and what theta
takes off a change doesn't speak for the reading, so that a poor fit hides nothing. In each further pass the outliers found
are taken out, the level shifts are set to no change, and the tests are repeated on what is left.

Defined cases: NULL, NaN and infinite measurements and rows without source or time take no part; a measurement outside
the physical limits is flagged as such and left out of the autoregression, but not of the stuck runs; a source with a
median of 0 flags any reversed move; ties in time are ordered by id; in the passes after the first a reading's neighbours are
sought among the REACH readings to either side; an empty input gives an empty result.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import sequence
from tidemark.operators.sequence import SMALL_KEY, chunk_window, chunked, exact_median, hot_hashes, in_run, key_hash
from tidemark.session import finite, settle

#: How far neighbours are sought once readings are taken out, the number of changes at which theta is halved, and the scales of a change that count in the next one's residual.
REACH, SHRINK, BOUND = 4, 30, 3.0


def with_runs(rows: DataFrame, keys: list[str], order: list[str], tests: dict[str, tuple[list[str], int]], small: int = SMALL_KEY, hot: list[int] | None = None) -> DataFrame:
    """Rows with a BOOLEAN per test: whether they belong to so many or more successive rows with equal values of its columns (NULL equals nothing)."""
    by = [F.col(c) for c in order]
    cut = chunked(rows, keys, by, max(n for _, n in tests.values()) - 1, small, hot=hot)
    return cut.withColumns({name: in_run(same, n, chunk_window(keys, by)) for name, (same, n) in tests.items()}).where("_own").drop("_chunk", "_own")


def fits(changes: DataFrame, key: str) -> DataFrame:
    """(key, _theta, _scale, _rows) of each source from its changes (_d) and the ones before (_d_1)."""
    moved = F.col("_d").isNotNull() & F.col("_d_1").isNotNull() & (F.col("_d") * F.col("_d_1") != 0)
    agree = F.avg(F.when(moved, F.signum(F.col("_d")) * F.signum(F.col("_d_1"))))
    n = F.count(F.when(moved, 1))
    theta = F.coalesce(F.sin(agree * (pi / 2)) * n / (n + SHRINK), F.lit(0.0))
    fitted = changes.groupBy(key).agg(theta.alias("_theta"), F.count(F.lit(1)).alias("_rows"))
    return fitted.join(exact_median(changes.select(key, F.abs("_d").alias("_abs")), [key], "_abs", "_scale").hint("merge"), key, "left")


def _near(value: Column, window, step: int, reach: int) -> Column:
    """The value of the nearest row to one side that has one."""
    return F.coalesce(*[F.lag(value, step * k).over(window) for k in range(1, reach + 1)])


def outliers(rows: DataFrame, key: str, order: list[str], value: str, times: float, passes: int = 3, small: int = SMALL_KEY, hot: list[int] | None = None) -> DataFrame:
    """Rows with large residuals: the input columns, ``kind`` ('outlier' or 'level shift'), ``in_pass`` (1 for the whole series), and
    ``strict``: whether the changes of the whole series alone, without a fit, exceed the limit and are reversed.

    ``value`` is a positive measurement; ``order`` must be unique within the key and end in an id.
    """
    by, w = [F.col(c) for c in order], chunk_window([key], [F.col(c) for c in order])
    hot = hot_hashes(rows, [key], small) if hot is None else hot
    halo = 3 + 3 * REACH * (passes - 1)
    cut = chunked(rows.withColumn("_x", F.ln(value)), [key], by, halo, small, hot=hot)
    first = cut.withColumn("_d", F.col("_x") - F.lag("_x").over(w))
    first = first.withColumn("_d_1", F.lag("_d").over(w)).withColumn("_d1", F.lead("_d").over(w))
    # the fit goes to each chunk of a key, so that a hot key isn't gathered again; it is merged, as it grows with the sources
    last = F.when(key_hash([key]).isin(hot), F.expr(f"_rows DIV {sequence.CHUNK_ROWS}")).otherwise(F.lit(0).cast("bigint"))
    fitted = fits(first.where("_own").select(key, "_d", "_d_1"), key).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).drop("_rows")
    left = first.join(fitted.hint("merge"), [key, "_chunk"]).withColumn("_limit", F.col("_scale") * times)
    left = left.withColumn("_out", F.lit(None).cast("int")).withColumn("_shift", F.lit(False))
    for turn in range(1, passes + 1):
        if turn > 1:
            # a shift beside what was taken out has yet to show itself
            beside = F.coalesce(F.lag("_new").over(w), F.lit(False)) | F.coalesce(F.lead("_new").over(w), F.lit(False))
            left = left.withColumn("_beside", beside).withColumn("_shift", F.col("_shift") | (F.col("_large") & ~F.col("_new") & ~F.col("_beside"))).withColumn("_k", F.when(F.col("_out").isNull(), F.col("_x")))
            left = left.withColumn("_d", F.when(F.col("_out").isNull(), F.when(F.col("_shift"), 0.0).otherwise(F.col("_x") - _near(F.col("_k"), w, 1, REACH))))
            left = left.withColumn("_d_1", _near(F.col("_d"), w, 1, REACH)).withColumn("_d1", _near(F.col("_d"), w, -1, REACH))
        reach = 1 if turn == 1 else REACH
        own = F.col("_out").isNull()
        left = left.withColumn("_d_2", _near(F.when(own, F.col("_d_1")), w, 1, reach)).withColumn("_d2", _near(F.when(own, F.col("_d1")), w, -1, reach))
        # (change, the one before) of the reading, the two after it, and the one before it
        steps = {"0": ("_d", "_d_1"), "1": ("_d1", "_d"), "2": ("_d2", "_d1"), "-1": ("_d_1", "_d_2")}

        def expected(before: str) -> Column:
            bound = F.col("_scale") * BOUND
            return F.when(F.col(before).isNull(), 0.0).otherwise(F.col("_theta") * F.greatest(F.least(F.col(before), bound), -bound))

        def reversed_by(at: str, to: str, fit: bool) -> Column:
            def beyond(step: str, sign: int) -> Column:
                part = expected(steps[step][1]) if fit else F.lit(0.0)
                return F.coalesce(sign * (F.col(steps[step][0]) - part) + F.abs(part) > F.col("_limit"), F.lit(False))

            return (beyond(at, 1) & beyond(to, -1)) | (beyond(at, -1) & beyond(to, 1))

        pairs = [("0", "1"), ("0", "2"), ("-1", "1")]
        any_of = lambda fit: reversed_by(*pairs[0], fit) | reversed_by(*pairs[1], fit) | reversed_by(*pairs[2], fit)  # noqa: B023, E731
        if turn == 1:
            left = left.withColumn("strict", any_of(False))
        large = F.coalesce(F.abs(F.col("_d") - expected("_d_1")) > F.col("_limit"), F.lit(False))
        left = left.withColumn("_new", own & any_of(True)).withColumn("_large", own & large)
        left = left.withColumn("_out", F.when(F.col("_new"), turn).otherwise(F.col("_out")))
    kind = F.when(F.col("_out").isNotNull(), "outlier").when(F.col("_large") | F.col("_shift"), "level shift")
    return left.withColumn("kind", kind).where("_own AND kind IS NOT NULL").select(*rows.columns, "kind", F.coalesce("_out", F.lit(passes)).alias("in_pass"), "strict")


def implausible(rows: DataFrame, key: str, order: list[str], value: str, above: float, most: float, times: float, run: int, passes: int = 3, small: int = SMALL_KEY, hot: list[int] | None = None) -> DataFrame:
    """All flags: the input columns, ``reason`` ('limit', 'spike', 'stuck'; a row per reading and reason), ``in_pass`` and ``strict``
    as ``outliers`` has them (1 and true for other reasons); input columns of these names give way to them.

    ``above``/``most`` are the physical limits (above < value <= most), ``times`` the spike threshold in scales,
    ``run`` the least length of a stuck run, ``hot`` the hashes of sources with many rows if known.
    """
    ids, own = [f"_o{i}" for i in range(len(order))], ("reason", "in_pass", "strict")
    kept = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row")
    named = rows.select(kept, F.col(key).alias("_key"), *[F.col(c).alias(i) for c, i in zip(order, ids)], finite(value).alias("_value"))
    good = settle(named.where("_key IS NOT NULL AND _o0 IS NOT NULL AND _value IS NOT NULL"))  # read by each test, and by the numbering of hot keys
    possible = (F.col("_value") > above) & (F.col("_value") <= most)
    hot = hot_hashes(good, ["_key"], small) if hot is None else hot
    spikes = outliers(good.where(possible), "_key", ids, "_value", times, passes, small, hot).where("kind = 'outlier'").select("_row", F.lit("spike").alias("reason"), "in_pass", "strict")
    held = with_runs(good, ["_key"], ids, {"_stuck": (["_value"], run)}, small, hot)
    reasons = F.array_compact(F.array(F.when(~possible, "limit"), F.when(F.col("_stuck"), "stuck")))
    rest = held.select("_row", F.explode(reasons).alias("reason"), F.lit(1).alias("in_pass"), F.lit(True).alias("strict"))
    return rest.unionByName(spikes).select(*[F.col("_row").getField(c).alias(c) for c in rows.columns if c not in own], *own)
