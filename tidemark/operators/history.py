"""History of changing attributes from periodic snapshots, by comparison of hash trees.

The observations of each period form a snapshot. A key's content in it is a hash of what was said of the key; the node of a
hash bucket is the combination of its keys' contents. From the top level on, each node is compared with the same node
in the last snapshot that has it: where they are equal, every key there only repeats what it said before, and the branch is
left. The next level's nodes are worked out for the differing branches alone, down to leaves of about one key; so the depth
follows the number of keys. Only the observations in differing leaves are compared in order of time and give versions.

Nothing is lost by leaving a branch: equal content means that each of its keys has one value there, the one of the
last differing leaf before. A key that is given two values within a period has a content that equals no other.

Defined cases: NULL values say nothing; a value that comes back is a new version; of several observations of a key at
one time the one told last holds, then the greatest value; rows without key or time are left out; an empty input gives an
empty result; further columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sequence import SMALL_KEY, chunk_window, chunked, hot_hashes
from tidemark.session import settle

#: Bits of a key's hash by which each level of the tree is finer than the one above.
FAN_BITS = 8


def contents(seen: DataFrame) -> DataFrame:
    """(_period, _hash, _content) per key hash and snapshot; all numbers, so the aggregate combines on the map side."""
    said = seen.groupBy("_period", "_hash").agg(F.min("_said").alias("_a"), F.max("_said").alias("_z"))
    one = F.xxhash64("_hash", "_a")
    return said.select("_period", "_hash", F.when(F.col("_a") == F.col("_z"), one).otherwise(F.xxhash64("_hash", "_a", "_z", "_period", F.lit("several"))).alias("_content"))


def _node(bits: int):
    return F.shiftrightunsigned("_hash", 64 - bits).alias("_node")


def depths(keys: int, fan: int = FAN_BITS) -> list[int]:
    """The levels' bits from the top to leaves of less than one key on average."""
    last = min(max(keys, 1).bit_length() + 1, 62)
    return [*range(fan, last, fan), last]


def differing(content: DataFrame, levels: list[int]) -> DataFrame:
    """(_period, _node) of the leaves that differ from their last snapshot, found from the top."""
    nodes = None
    for bits in levels:
        rows = content.select("_period", "_hash", "_content", _node(bits))
        if nodes is not None:
            rows = rows.withColumn("_up", F.shiftrightunsigned("_node", bits - above)).join(nodes.withColumnRenamed("_node", "_up"), ["_period", "_up"], "left_semi")
        held = rows.groupBy("_period", "_node").agg(F.struct(F.bit_xor("_content").alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "_content")).alias("b"), F.count(F.lit(1)).alias("n")).alias("_now"))
        before = F.lag("_now").over(Window.partitionBy("_node").orderBy("_period"))
        nodes, above = held.withColumn("_before", before).where("NOT (_now <=> _before)").select("_period", "_node"), bits
    return nodes


def history(rows: DataFrame, key: str, at: str, value: str, period: str, told: str | None = None, small: int = SMALL_KEY, fan: int = FAN_BITS) -> DataFrame:
    """Versions as (key, value, valid_from, valid_to, current): [valid_from, valid_to) in the type of ``at``, NULL for the last.

    ``period`` is an SQL expression over ``at`` named ``_at`` that numbers the snapshots in order, such as
    ``year(_at) * 12 + month(_at)``; ``told`` is the time at which an observation became known, if that isn't ``at``. A key
    with a third of all rows counts as one content per period, and its compared rows are cut into chunks.
    """
    seen = rows.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.col(value).alias("_value"), F.col(told or at).alias("_told")).where("_key IS NOT NULL AND _at IS NOT NULL AND _value IS NOT NULL")
    seen = settle(seen.withColumns({"_period": F.expr(period).cast("bigint"), "_hash": F.xxhash64("_key"), "_said": F.xxhash64("_value")}))  # read for the tree and by the comparison
    content = settle(contents(seen))
    levels = depths(content.agg(F.approx_count_distinct("_hash")).first()[0], fan)
    inside = seen.select("*", _node(levels[-1])).join(differing(content, levels), ["_period", "_node"], "left_semi")
    held = inside.groupBy("_key", "_at").agg(F.max(F.struct("_told", "_value"))["_value"].alias("_value"))
    hot = hot_hashes(seen, ["_key"], small)
    cut = chunked(held, ["_key"], [F.col("_at")], 1, small, hot=hot)
    w = chunk_window(["_key"], [F.col("_at")])
    starts = cut.withColumn("_before", F.lag("_value").over(w)).where("_own").where("NOT (_value <=> _before)").select("_key", "_at", "_value")
    cut = chunked(starts, ["_key"], [F.col("_at")], 1, small, hot=hot)
    versions = cut.withColumn("valid_to", F.lead("_at").over(w)).where("_own")
    return versions.select(F.col("_key").alias(key), F.col("_value").alias(value), F.col("_at").alias("valid_from"), "valid_to", F.col("valid_to").isNull().alias("current"))
