"""Matching records by nearest time within a tolerance.

Both tables are cut by entity and time slot and hash-partitioned into Arrow groups; inside a group DuckDB joins backward
and forward with ASOF, and the nearer candidate within the tolerance is taken.

Of the records in other slots only the last one before and the first one after can be nearest, so each slot hands just
its first and last record on to the slots within the tolerance. That keeps the groups disjoint and small: entities with
many records get narrow slots, and no entity is ever gathered whole.

Defined cases: rows with a NULL entity, time or id, and records with a NULL value, match nothing; of records with one
entity and time the one with the least id counts; at equal distance the earlier record is taken; repeated events have
one row; only the named columns are read, so further columns can't clash; empty tables give an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sequence import SMALL_KEY, hot_hashes, key_hash
from tidemark.session import micros, shuffle_parts

#: Rows that an Arrow group is meant to hold, and the slot widths in hours of usual and of hot entities.
GROUP_ROWS, SLOT_HOURS, HOT_SLOT_HOURS = 50_000, 24 * 30, 1

NEAREST = """
WITH back AS (SELECT e.event_id, e.entity, e.t, r.id, r.t AS r_t FROM events e ASOF LEFT JOIN records r ON e.entity = r.entity AND e.slot = r.slot AND e.t >= r.t),
ahead AS (SELECT e.event_id, e.entity, e.t, r.id, r.t AS r_t FROM events e ASOF LEFT JOIN records r ON e.entity = r.entity AND e.slot = r.slot AND e.t <= r.t)
SELECT b.event_id AS event_id, CASE WHEN a.id IS NULL OR b.t - b.r_t <= a.r_t - a.t THEN b.id ELSE a.id END AS id,
       CASE WHEN a.id IS NULL OR b.t - b.r_t <= a.r_t - a.t THEN b.r_t ELSE a.r_t END AS r_t, b.t AS t
FROM back b JOIN ahead a ON a.event_id = b.event_id AND a.entity = b.entity AND a.t = b.t
"""


def nearest(events: DataFrame, records: DataFrame, event_id: str, record_id: str, entity: str, event_ts: str, record_ts: str, value: str, tolerance_hours: float, small: int = SMALL_KEY) -> DataFrame:
    """(event_id, record_id, distance in seconds, positive if the record is later) for events with a record within the tolerance.

    ``event_id`` is STRING, ``record_id`` BIGINT; both tables have the column ``entity``.
    """
    tolerance = int(tolerance_hours * 3_600_000_000)
    points = events.select(F.col(event_id).cast("string").alias("event_id"), F.col(entity).alias("entity"), micros(event_ts).alias("at")).where("event_id IS NOT NULL AND entity IS NOT NULL AND at IS NOT NULL").distinct()
    marks = records.where(F.col(value).isNotNull()).select(F.col(record_id).cast("bigint").alias("id"), F.col(entity).alias("entity"), micros(record_ts).alias("at"))
    marks = marks.where("id IS NOT NULL AND entity IS NOT NULL AND at IS NOT NULL").groupBy("entity", "at").agg(F.min("id").alias("id"))

    hot = hot_hashes(records.select(F.col(entity).alias("entity")).unionByName(events.select(F.col(entity).alias("entity"))), ["entity"], small)
    hour = 3_600_000_000
    width = F.when(key_hash(["entity"]).isin(hot), HOT_SLOT_HOURS * hour).otherwise(SLOT_HOURS * hour) if hot else F.lit(SLOT_HOURS * hour)
    slotted = lambda df: df.withColumn("_w", width.cast("bigint")).withColumn("slot", F.expr("(at - pmod(at, _w)) DIV _w"))
    points, marks = slotted(points), slotted(marks)
    ends = marks.groupBy("entity", "slot", "_w").agg(F.min("at").alias("_a"), F.min_by("id", "at").alias("_a_id"), F.max("at").alias("_z"), F.max_by("id", "at").alias("_z_id"))
    reached = ends.selectExpr("*", f"(_a - {tolerance} - pmod(_a - {tolerance}, _w)) DIV _w AS _from", f"(_z + {tolerance} - pmod(_z + {tolerance}, _w)) DIV _w AS _to")
    back = reached.selectExpr("entity", "explode(filter(sequence(_from, slot), s -> s < slot)) AS slot", "_a AS at", "_a_id AS id")
    ahead = reached.selectExpr("entity", "explode(filter(sequence(slot, _to), s -> s > slot)) AS slot", "_z AS at", "_z_id AS id")
    marks = marks.select("entity", "slot", "at", "id").unionByName(back).unionByName(ahead)

    rows = events.count() + records.count()  # from the files' footers where the tables are plain scans
    groups = max(shuffle_parts(events.sparkSession), -(-rows // GROUP_ROWS))
    group = F.pmod(F.xxhash64("entity", "slot"), F.lit(groups)).alias("_group")
    left = points.select(group, "event_id", "entity", "slot", F.col("at").alias("t"))
    right = marks.select(group, "entity", "slot", F.col("at").alias("t"), "id")
    result = pa.schema([("event_id", pa.string()), ("record_id", pa.int64()), ("distance_s", pa.float64())])

    def match(e: pa.Table, r: pa.Table) -> pa.Table:
        import duckdb

        if not e.num_rows or not r.num_rows:
            return result.empty_table()
        with duckdb.connect(config={"threads": 1}) as db:
            db.register("events", e)
            db.register("records", r)
            found = db.sql(f"SELECT event_id, CAST(id AS BIGINT) AS record_id, (r_t - t) / 1e6 AS distance_s FROM ({NEAREST}) WHERE id IS NOT NULL AND abs(r_t - t) <= {tolerance}").to_arrow_table()
        return found.cast(result)

    return left.groupBy("_group").cogroup(right.groupBy("_group")).applyInArrow(match, "event_id string, record_id bigint, distance_s double")

