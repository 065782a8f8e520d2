"""Ordered work within keys that stays whole and balanced when one key holds a third of all rows.

``chunked`` is the basis: a key with few rows stays one sorted group; the rows of a hot key get their exact positions by a
range partitioning of (key, order), are cut into chunks of equal size and carry the few neighbours that a bounded window
frame can reach. Windows over (key, chunk) then give the same values as windows over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle, shuffle_parts

#: Keys with at most this many rows are never split.
SMALL_KEY = 50_000
#: Rows of a hot key that one task sorts at a time.
CHUNK_ROWS = 20_000
#: Keys that are split, at most so many per shuffle partition: of n keys split, every other holds less than 1/n of all rows,
#: a quarter of a partition's even share here, so that splitting it as well would balance nothing.
HOT_PER_PARTITION = 4
#: Over how many join partitions the rows of a hot key are spread.
SALTS = 64


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def hot_hashes(df: DataFrame, keys: list[str], small: int = SMALL_KEY) -> list[int]:
    """Hashes of the largest keys with more than ``small`` rows, at most HOT_PER_PARTITION per shuffle partition (the bound of what is collected)."""
    counts = df.select(key_hash(keys).alias("_h")).groupBy("_h").count().where(F.col("count") > small)
    return [r["_h"] for r in counts.orderBy(F.desc("count"), "_h").limit(HOT_PER_PARTITION * shuffle_parts(df.sparkSession)).collect()]


def salted(df: DataFrame, keys: list[str], hot: list[int]) -> DataFrame:
    """Add ``_salt``: 0 to SALTS - 1 by the row's content for hot keys, 0 for all others."""
    if not hot:
        return df.withColumn("_salt", F.lit(0))
    plain = [F.col(c) for c, kind in df.dtypes if not kind.startswith("map")]
    return df.withColumn("_salt", F.when(key_hash(keys).isin(hot), F.pmod(F.xxhash64(F.lit(17), *plain), F.lit(SALTS)).cast("int")).otherwise(0))


def replicated(df: DataFrame, keys: list[str], hot: list[int]) -> DataFrame:
    """The other side of a join with ``salted`` rows: a row per salt for hot keys."""
    if not hot:
        return df.withColumn("_salt", F.lit(0))
    return df.withColumn("_salt", F.explode(F.when(key_hash(keys).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))


def lookup(df: DataFrame, table: DataFrame, keys: list[str], hot: list[int] | None = None, small: int = SMALL_KEY) -> DataFrame:
    """Left join with a table of one row per key; the rows of hot keys are spread over SALTS partitions."""
    hot = hot_hashes(df, keys, small) if hot is None else hot
    return salted(df, keys, hot).join(replicated(table, keys, hot), [*keys, "_salt"], "left").drop("_salt")


def ordered(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows range-partitioned by key and order and numbered by ``_mid``, which rises with them; settled, so that all later reads see the same numbers.

    ``order`` must end in something unique within the key. No partition grows with a hot key, as the ranges cut it.
    """
    columns = [F.col(k) for k in keys] + order
    ranged = df.repartitionByRange(shuffle_parts(df.sparkSession), *columns).sortWithinPartitions(*columns)
    return settle(ranged.withColumn("_mid", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_mid", 33))


def offsets(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """For each key and partition of ``ordered`` rows: the first ``_mid``, the rows there, those in earlier partitions, and those of the key."""
    parts = ranked.groupBy(*keys, "_part").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_here"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_before", F.coalesce(F.sum("_here").over(before), F.lit(0))).withColumn("_all", F.sum("_here").over(Window.partitionBy(*keys)))


def positions(df: DataFrame, keys: list[str], order: list[Column], name: str = "_pos", hot: list[int] | None = None) -> DataFrame:
    """Each row's exact position (from 0) within its key; NULL keys are a key of their own. With ``hot`` empty, as ``hot_hashes`` found it, one sort per key will do."""
    if hot == []:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint") - 1)
    own = [f"_key{i}" for i in range(len(keys))]
    ranked = ordered(df.withColumns({o: F.col(k) for o, k in zip(own, keys)}), own, order)
    where = offsets(ranked, own).select(*[F.col(o).alias(f"_o{o}") for o in own], F.col("_part").alias("_o_part"), "_first", "_before")
    match = F.col("_part") == F.col("_o_part")
    for o in own:
        match = match & F.col(o).eqNullSafe(F.col(f"_o{o}"))
    return ranked.join(where, match).select(*df.columns, (F.col("_mid") - F.col("_first") + F.col("_before")).alias(name))


def chunked(df: DataFrame, keys: list[str], order: list[Column], halo: int, small: int = SMALL_KEY, rows: int | None = None, hot: list[int] | None = None) -> DataFrame:
    """Add ``_chunk`` and ``_own``: within (keys, _chunk) a frame of ``halo`` rows to either side is complete for the rows with ``_own``.

    Compute the windows over (keys, _chunk), then keep the rows with ``_own``; each row has exactly one.
    """
    rows = CHUNK_ROWS if rows is None else rows
    if rows < 2 * halo:
        raise ValueError("a chunk must hold at least twice the halo")
    hot = hot_hashes(df, keys, small) if hot is None else hot
    whole = lambda x: x.withColumn("_chunk", F.lit(0).cast("bigint")).withColumn("_own", F.lit(True))
    if not hot:
        return whole(df)
    is_hot = key_hash(keys).isin(hot)
    cut = positions(df.where(is_hot), keys, order)
    at, within = F.expr(f"_pos DIV {rows}"), F.col("_pos") % rows
    homes = F.array_compact(F.array(at, F.when((within < halo) & (at > 0), at - 1), F.when(within >= rows - halo, at + 1)))
    cut = cut.withColumn("_chunk", F.explode(homes)).withColumn("_own", F.col("_chunk") == at)
    return whole(df.where(~is_hot)).unionByName(cut.select(*df.columns, "_chunk", "_own"))


def chunk_window(keys: list[str], order: list[Column]) -> Window:
    return Window.partitionBy(*keys, "_chunk").orderBy(*order)


def in_run(same: list[str], length: int, window: Window) -> Column:
    """Whether the row belongs to ``length`` or more successive rows with equal, non-NULL values in ``same``; needs a halo of length - 1."""
    def equal(step: int) -> Column:
        out = F.lit(True)
        for c in same:
            out = out & (F.col(c) == F.lag(c, step).over(window))
        return F.coalesce(out, F.lit(False))

    def reach(sign: int) -> Column:
        out = F.when(~equal(sign), 0)
        for step in range(2, length):
            out = out.when(~equal(sign * step), step - 1)
        return out.otherwise(length - 1)

    return reach(1) + reach(-1) + 1 >= length


def exact_median(df: DataFrame, keys: list[str], value: str, name: str, hot: list[int] | None = None) -> DataFrame:
    """The exact median of ``value`` (NULLs left out) per key, the mean of the middle two of an even count. With ``hot`` empty the values of a key are ordered in one place.

    A histogram of 64 bins per doubling finds the bins that hold the middle, and only the distinct values there are
    ordered, so no group holds all values of a hot key. All aggregates combine on the map side.
    """
    v = F.col(value)
    if hot == []:
        return df.where(v.isNotNull()).groupBy(*keys).agg(F.percentile(v, F.lit(0.5)).alias(name))
    counts = df.where(v.isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bin", _bin(v))
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_in"))
    by_key = Window.partitionBy(*keys)
    running = by_key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_under", F.coalesce(F.sum("_in").over(running), F.lit(0))).withColumn("_total", F.sum("_in").over(by_key))
    bins = bins.withColumn("_lo", F.floor((F.col("_total") - 1) / 2)).withColumn("_hi", F.floor(F.col("_total") / 2))
    covers = lambda r, under, n: (F.col(under) <= F.col(r)) & (F.col(r) < F.col(under) + F.col(n))
    middle = bins.where(covers("_lo", "_under", "_in") | covers("_hi", "_under", "_in")).select(*keys, "_bin", "_under", "_lo", "_hi")
    inside = counts.join(middle, [*keys, "_bin"])
    running = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_under", F.col("_under") + F.coalesce(F.sum("_n").over(running), F.lit(0)))
    pick = lambda r: F.max(F.when(covers(r, "_under", "_n"), v))
    return inside.groupBy(*keys).agg(((pick("_lo") + pick("_hi")) / 2).alias(name))


def _bin(v: Column) -> Column:
    """64 bins per doubling, in the order of the values."""
    size = F.floor(F.log2(F.abs(v)) * 64).cast("int") + 100_000
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size)


def distinct_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, _ties, _below, _total) for each distinct value: rows with it, with a smaller one, and in all.

    Bins give the rows below a bin, and only the distinct values of one bin are ordered together.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties")).withColumn("_bin", _bin(F.col(value)))
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_ties").alias("_in"))
    by_key = Window.partitionBy(*keys)
    before = Window.unboundedPreceding, -1
    bins = bins.select(*keys, "_bin", F.coalesce(F.sum("_in").over(by_key.orderBy("_bin").rowsBetween(*before)), F.lit(0)).alias("_base"), F.sum("_in").over(by_key).alias("_total"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(*before)
    return counts.join(bins, [*keys, "_bin"]).select(*keys, value, "_ties", (F.col("_base") + F.coalesce(F.sum("_ties").over(inside), F.lit(0))).alias("_below"), "_total")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], name: str, hot: list[int] | None = None) -> DataFrame:
    """(keys, name): exact quantiles with linear interpolation as an array in the order of ``probs``. ``hot`` as in ``exact_median``."""
    if hot == []:
        return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])).alias(name))
    ranks = distinct_ranks(df, keys, value)
    picks = []
    for p in probs:
        at = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.floor(at + 1e-9), F.ceil(at - 1e-9)
        picks += [F.max(F.when((F.col("_below") <= r) & (r < F.col("_below") + F.col("_ties")), F.col(value))).alias(f"_q{len(picks) + i}") for i, r in enumerate((lo, hi))]
    found = ranks.groupBy(*keys).agg(*picks, F.max("_total").alias("_total"))
    values = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        part = at - F.floor(at + 1e-9)
        low, high = F.col(f"_q{2 * i}"), F.col(f"_q{2 * i + 1}")
        values.append(low + F.greatest(part, F.lit(0.0)) * (high - low))
    return found.select(*keys, F.array(*values).alias(name))
