"""Point-in-time security master: names, flags, listings, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import CORRECTION_WORDS, flagged_name, report_label
from tidemark.operators.validity import interval_join

#: Fixed value: names before the first known change hold from here on.
BEGINNING = "1900-01-01"
#: What a sample's overlap with the delisted codes says.
SAMPLE_EMPTY = "空样本"
NONE_DELISTED = "样本内无后来退市公司: 数据源疑似剔除退市股, 存在幸存者偏差"
SOME_DELISTED = "样本包含后来退市公司"


def name_timeline(changes: DataFrame) -> DataFrame:
    """(code, valid_from, valid_to, name) from (code, change_date, name_before, name_after); the last change of a day holds."""
    by = Window.partitionBy("code").orderBy("change_date")
    last = changes.where("code IS NOT NULL AND change_date IS NOT NULL").groupBy("code", "change_date").agg(F.max(F.struct("name_after", "name_before")).alias("_n")).select("code", "change_date", "_n.name_after", "_n.name_before")
    first = last.groupBy("code").agg(F.min_by("name_before", "change_date").alias("name")).select("code", F.lit(BEGINNING).cast("date").alias("valid_from"), "name")
    rest = last.select("code", F.col("change_date").alias("valid_from"), F.col("name_after").alias("name"))
    return first.unionByName(rest).withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("code").orderBy("valid_from"))).select("code", "valid_from", "valid_to", "name")


def name_as_of(events: DataFrame, timeline: DataFrame, date: str) -> DataFrame:
    """Events with ``name_then``, the name valid at ``date``; NULL without history. ``events`` needs a unique event_id and a code."""
    days = timeline.select("code", F.unix_date("valid_from").cast("bigint").alias("_vf"), F.unix_date("valid_to").cast("bigint").alias("_vt"), F.col("name").alias("name_then"))
    points = events.select("event_id", "code", F.unix_date(date).cast("bigint").alias("_d"))
    found = interval_join(points, days, ["code"], [("_d", "_vf", "_vt")]).select("event_id", "name_then")
    return events.join(found, "event_id", "left")


def flag_status(events: DataFrame, timeline: DataFrame, date: str, current_name: str) -> DataFrame:
    """Events with is_flagged and flag_basis: the name at the time if there is a history, else today's name, else unknown (NULL)."""
    named = name_as_of(events, timeline, date)
    basis = F.when(F.col("name_then").isNotNull(), "history").when(F.col(current_name).isNotNull(), "current").otherwise("unknown")
    return named.withColumn("flag_basis", basis).withColumn("is_flagged", flagged_name(F.coalesce("name_then", current_name)))


def drop_flagged(events: DataFrame) -> DataFrame:
    """Without the flagged ones; those of unknown state stay."""
    return events.where("NOT (is_flagged <=> true)")


def listed(events: DataFrame, listing: DataFrame, delisting: DataFrame, date: str) -> DataFrame:
    """Events whose code was listed by ``date`` and not delisted up to it."""
    l = listing.groupBy("code").agg(F.min("list_date").alias("_list"))
    d = delisting.groupBy("code").agg(F.min("delist_date").alias("_delist"))
    return events.join(l, "code").join(d, "code", "left").where((F.col("_list") <= F.col(date)) & (F.col("_delist").isNull() | (F.col("_delist") > F.col(date)))).drop("_list", "_delist")


def flag_delisted(rows: DataFrame, delisting: DataFrame, date: str) -> DataFrame:
    d = delisting.groupBy("code").agg(F.min("delist_date").alias("delist_date"))
    return rows.join(d, "code", "left").withColumn("is_delisted", F.coalesce(F.col("delist_date") <= F.col(date), F.lit(False)))


def survivorship(events: DataFrame, delisting: DataFrame) -> DataFrame:
    """One row: events, codes and events of codes in ``delisting``, the codes' share, and the finding."""
    gone = events.select("code").join(delisting.select("code").distinct().withColumn("_d", F.lit(1)), "code", "left")
    codes, hit = F.countDistinct("code"), F.count("_d")
    later = F.countDistinct(F.when(F.col("_d").isNotNull(), F.col("code")))
    flag = F.when(F.count(F.lit(1)) == 0, SAMPLE_EMPTY).when(hit == 0, NONE_DELISTED).otherwise(SOME_DELISTED)
    return gone.agg(F.count(F.lit(1)).alias("events"), codes.alias("codes"), later.alias("codes_delisted"), hit.alias("events_delisted"), F.try_divide(later.cast("double"), codes).alias("share"), flag.alias("finding"))


def first_per_code(*tables: DataFrame, date: str) -> DataFrame:
    """The union of boards in which the first table that has a code wins; rows without ``date`` are left out."""
    union = None
    for n, t in enumerate(tables):
        part = t.withColumn("_board", F.lit(n))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    held = union.where(F.col(date).isNotNull())
    columns = [c for c in held.columns if c not in ("code", "_board")]
    return held.groupBy("code").agg(F.min_by(F.struct(*columns), F.struct("_board", date)).alias("_r")).select("code", "_r.*")


def corrections(events: DataFrame, disclosures: DataFrame, date: str, window_days: int = 120, pattern: str = CORRECTION_WORDS) -> DataFrame:
    """Per event the titles in (date, date + window]: counts of all, of corrections, and of corrections to the event's own report.

    An event looks into the one or two time buckets of its window, so no pairs outside of it are made.
    """
    start = F.unix_date(date).cast("bigint")
    spans = events.select("event_id", "code", "report_date", (start + 1).alias("_from"), (start + window_days + 1).alias("_to"))
    titles = disclosures.select("code", "title", F.unix_date("date").cast("bigint").alias("_d"))
    met = interval_join(titles, spans, ["code"], [("_d", "_from", "_to")])
    met = met.withColumn("_hit", F.col("title").rlike(pattern))
    own = F.col("_hit") & F.contains(F.col("title"), report_label(F.col("report_date")))
    titles = F.expr("listagg(CASE WHEN _hit THEN title END, ' | ') WITHIN GROUP (ORDER BY _d, title)")
    found = met.groupBy("event_id").agg(F.count(F.lit(1)).alias("announcements"), F.count_if("_hit").alias("corrections"), F.count_if(own).alias("report_corrections"), titles.alias("titles"))
    out = events.select("event_id").distinct().join(found, "event_id", "left").na.fill(0, ["announcements", "corrections", "report_corrections"]).na.fill("", ["titles"])
    return out.withColumn("report_corrected", F.col("report_corrections") > 0)


def correction_audit(scanned: DataFrame) -> DataFrame:
    """One row over the events of ``corrections``: events, those with announcements, those whose report was corrected, and their share."""
    told = F.count_if(F.col("announcements") > 0)
    return scanned.agg(F.count(F.lit(1)).alias("events"), told.alias("with_announcements"), F.count_if("report_corrected").alias("corrected"), F.avg(F.col("report_corrected").cast("double")).alias("corrected_rate"), F.sum("announcements").alias("announcements"))


def flag_audit(flagged: DataFrame) -> DataFrame:
    """One row over ``flag_status`` rows: events, flagged and unknown ones, events by basis, and the flagged share of the known."""
    by = lambda b: F.count_if(F.col("flag_basis") == b)
    return flagged.agg(F.count(F.lit(1)).alias("events"), F.count_if("is_flagged").alias("flagged"), F.count_if(F.col("is_flagged").isNull()).alias("unknown"), by("history").alias("by_history"), by("current").alias("by_current"), by("unknown").alias("by_unknown"), F.avg(F.col("is_flagged").cast("double")).alias("flagged_share"))
