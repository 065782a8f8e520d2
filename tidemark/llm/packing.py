"""Filling containers of fixed capacity with items, by best-two-fit.

A container is filled greedily with the largest items that fit; then its smallest item is replaced by the two unpacked items
that fill the widened gap more tightly, as long as that helps. Items of equal size are alike, so the plan is made on
the histogram of sizes: a filled container stands for as many equal ones as the histogram yields. Its work is bounded
by the capacity, not by the number of items, which then take their places by their exact rank among items of their size.

Defined cases: an item over the capacity is split into full containers and a rest that is packed like an item; items of
size 0 take no room and stand in container 0; NULL sizes count as 0; an empty input gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sequence import positions
from tidemark.session import settle

#: Bits of a combined (size, rank) key that hold the rank.
RANK_BITS = 40


def _two(sizes: list[int], left: dict[int, int], room: int, over: int) -> tuple[int, int] | None:
    """The two available items with the greatest sum in (over, room]."""
    best, found = over, None
    lo, hi = 0, bisect_right(sizes, room) - 1
    while lo <= hi:
        a, b = sizes[lo], sizes[hi]
        if a + b > room:
            hi -= 1
            continue
        if left[b] <= 0:
            hi -= 1
            continue
        if left[a] <= 0 or (lo == hi and left[a] < 2):
            lo += 1
            continue
        if a + b > best:
            best, found = a + b, (a, b)
            if best == room:
                break
        lo += 1
    return found


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how many containers, {size: items in each}) in order of packing; ``counts`` are items by size, 1 to ``capacity``."""
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    out = []
    while sizes:
        use: dict[int, int] = {}
        gap = capacity
        at = len(sizes) - 1
        while at >= 0 and gap > 0:
            s = sizes[at]
            n = min(left[s], gap // s)
            if n:
                use[s] = n
                left[s] -= n
                gap -= n * s
            at = min(at - 1, bisect_right(sizes, gap) - 1)
        while gap > 0:
            small = min(use)
            pair = _two(sizes, left, gap + small, small)
            if pair is None:
                break
            use[small] -= 1
            left[small] += 1
            if not use[small]:
                del use[small]
            for s in pair:
                use[s] = use.get(s, 0) + 1
                left[s] -= 1
            gap += small - sum(pair)
        more = min(left[s] // n for s, n in use.items())
        for s, n in use.items():
            left[s] -= n * more
        out.append((more + 1, use))
        if any(left[s] == 0 for s in use):
            sizes = [s for s in sizes if left[s] > 0]
    return out


@dataclass
class Places:
    """For each size, from which rank on items go to which containers, ``per`` to each."""

    keys: np.ndarray
    start: np.ndarray
    first: np.ndarray
    per: np.ndarray
    containers: int

    def of(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, (size << RANK_BITS) + rank, side="right") - 1
        return self.first[at] + (rank - self.start[at]) // self.per[at]


def places(packed: list[tuple[int, dict[int, int]]]) -> Places:
    taken: dict[int, int] = {}
    rows, first = [], 0
    for copies, use in packed:
        for size, per in use.items():
            start = taken.get(size, 0)
            rows.append(((size << RANK_BITS) + start, start, first, per))
            taken[size] = start + per * copies
        first += copies
    table = np.asarray(sorted(rows), np.int64).reshape(-1, 4)
    return Places(table[:, 0], table[:, 1], table[:, 2], table[:, 3], first)


def pack(items: DataFrame, ident: str, size: str, capacity: int) -> DataFrame:
    """(ident, piece, start, size, container): each item once, those over the capacity in pieces from ``start`` on."""
    whole = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    pieces = items.select(F.col(ident).alias("_id"), whole.alias("_whole"))
    pieces = pieces.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.greatest(F.expr(f"CAST((_whole - 1) DIV {capacity} AS INT)"), F.lit(0)))))
    pieces = pieces.withColumn("_start", F.col("_piece").cast("bigint") * capacity)
    pieces = settle(pieces.select("_id", "_piece", "_start", F.least(F.col("_whole") - F.col("_start"), F.lit(capacity).cast("bigint")).alias("_size")))
    histogram = {r["_size"]: r["count"] for r in pieces.where("_size > 0").groupBy("_size").count().collect()}  # at most ``capacity`` rows
    seats = items.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))
    ranked = positions(pieces.where("_size > 0"), ["_size"], [F.col("_id"), F.col("_piece")], "_rank")
    kind = pieces.schema["_id"].dataType.simpleString()

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = seats.value.of(b.column("_size").to_numpy(), b.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("_id", "_piece", "_start", "_size")], pa.array(where, pa.int64())], names=["_id", "_piece", "_start", "_size", "_container"])

    seated = ranked.mapInArrow(seat, f"_id {kind}, _piece int, _start bigint, _size bigint, _container bigint")
    none = pieces.where("_size = 0").withColumn("_container", F.lit(0).cast("bigint"))
    return seated.unionByName(none).select(F.col("_id").alias(ident), F.col("_piece").alias("piece"), F.col("_start").alias("start"), F.col("_size").alias("size"), F.col("_container").alias("container"))
