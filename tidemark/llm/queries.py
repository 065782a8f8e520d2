"""Queries of the llm subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packing, subjects, tokens
from tidemark.llm.cutoff import cutoffs, holding_scores
from tidemark.llm.nearest import nearest
from tidemark.session import micros, settle
from tidemark.sources.tables import canonical_code, read

#: Problem 2: the tolerance in hours.
NEAREST_HOURS = 36
#: Problem 9: tokens of a container.
CONTAINER_TOKENS = 2048


def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the nearest snapshot of its code within the tolerance, the distance and its ``float_mcap``."""
    found = _nearest(spark, sf_dir)
    values = read(spark, sf_dir, "liquidity").select(F.col("liq_id").cast("bigint").alias("liq_id"), "float_mcap").where("float_mcap IS NOT NULL").groupBy("liq_id").agg(F.max("float_mcap").alias("float_mcap"))
    return found.join(values, "liq_id").select("event_id", "liq_id", "distance_s", "float_mcap")


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "event_panel").select("event_id", canonical_code("code").alias("code"), "tradable_ts")
    snapshots = read(spark, sf_dir, "liquidity").select("liq_id", canonical_code("code").alias("code"), "date", "float_mcap")
    return nearest(events, snapshots, "event_id", "liq_id", "code", "tradable_ts", "date", "float_mcap", NEAREST_HOURS).withColumnRenamed("record_id", "liq_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("event_id", "liq_id").distinct()


def _cutoffs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "engine").select(F.col("cand_id").cast("bigint").alias("cand_id"), "run_id", "cohort", "score", micros("scored_ts").alias("scored"))
    targets = read(spark, sf_dir, "backtest_cohorts").groupBy("run_id", "cohort").agg(F.max("target_pct").alias("target_pct"))
    return cutoffs(holding_scores(rows, ["run_id", "cohort"], "cand_id", "score", "scored"), targets, ["run_id", "cohort"], "cand_id", "score", "target_pct")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cutoffs(spark, sf_dir)[0].select("cand_id")


def p4_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutoff and sizes of each run and cohort beside the counts once reported."""
    report = _cutoffs(spark, sf_dir)[1]
    stated = read(spark, sf_dir, "backtest_cohorts").select("run_id", "cohort", "target_pct", "n_candidates", "n_selected").dropDuplicates(["run_id", "cohort"])
    agree = (F.col("n_scored") == F.col("n_candidates")) & (F.col("n_kept") == F.col("n_selected"))
    return report.join(stated, ["run_id", "cohort"]).select("run_id", "cohort", "target_pct", "cutoff", "n_scored", "n_kept", "n_candidates", "n_selected", agree.alias("counts_agree"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(read(spark, sf_dir, "documents"), "doc_id", "text", tokens.vocabulary(spark))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of what must hold: every document has ids, and the bytes of the ids joined are the text (empty for NULL)."""
    ranks, texts = tokens.vocabulary(spark), read(spark, sf_dir, "documents").select("doc_id", "text")
    back = tokens.decode(tokens.encode(texts, "doc_id", "text", ranks), "doc_id", "ids", ranks).withColumnRenamed("text", "_back")
    both = texts.join(back, "doc_id", "full_outer")
    same = F.col("_back") == F.coalesce("text", F.lit(""))
    return both.agg(F.count("_back").alias("documents"), F.count_if(F.col("_back").isNull()).alias("missing"), F.count_if(~F.coalesce(same, F.lit(False))).alias("unequal"))


def p9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each post (or piece of one over a container) with its tokens and its container."""
    sizes = tokens.encode(read(spark, sf_dir, "documents"), "doc_id", "text", tokens.vocabulary(spark), count=True)
    packed = packing.pack(sizes, "doc_id", "n", CONTAINER_TOKENS)
    return packed.select("doc_id", "piece", F.col("start").alias("first_token"), F.col("size").alias("n_tokens"), "container")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, the least that any packing needs, and the share of room that is used."""
    packed = p9_pack(spark, sf_dir).where("n_tokens > 0")
    loads = packed.groupBy("container").agg(F.sum("n_tokens").alias("load"), F.count(F.lit(1)).alias("pieces"))
    total = loads.agg(F.count(F.lit(1)).alias("containers"), F.sum("load").alias("tokens"), F.sum("pieces").alias("pieces"), F.max("load").alias("fullest"))
    return total.select("containers", "pieces", "tokens", "fullest", F.ceil(F.col("tokens") / CONTAINER_TOKENS).alias("least_containers"), (F.col("tokens") / (F.col("containers") * CONTAINER_TOKENS)).alias("fill"))


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of what must hold: every post is in a container or several in a row, none is split that fits one, none lost, and no container is too full."""
    packed = settle(p9_pack(spark, sf_dir))
    sizes = tokens.encode(read(spark, sf_dir, "documents"), "doc_id", "text", tokens.vocabulary(spark), count=True)
    per = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_pieces"), F.sum("n_tokens").alias("_packed"))
    both = sizes.join(per, "doc_id", "full_outer")
    posts = both.agg(F.count("n").alias("posts"), F.count_if(F.col("_packed").isNull()).alias("missing"), F.count_if(F.col("n").isNull()).alias("unknown"), F.count_if(F.col("n") != F.col("_packed")).alias("other_size"), F.count_if((F.col("n") <= CONTAINER_TOKENS) & (F.col("_pieces") > 1)).alias("split_needlessly"))
    full = packed.groupBy("container").agg(F.sum("n_tokens").alias("_load")).agg(F.count_if(F.col("_load") > CONTAINER_TOKENS).alias("over_full"))
    return posts.withColumn("_one", F.lit(1)).join(full.withColumn("_one", F.lit(1)), "_one").drop("_one")


def p10_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of what must hold: as many posts and characters as the corpus has, no subject or post that isn't there, no subject of a blank post, none twice."""
    found = settle(p10_scores(spark, sf_dir))
    texts = read(spark, sf_dir, "documents").select("doc_id", "text")
    per = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"), F.countDistinct("subject").alias("_subjects"), F.min("score").alias("_least"), F.max("score").alias("_most"))
    both = texts.join(per, "doc_id", "full_outer")
    known = read(spark, sf_dir, "subjects").select("subject").distinct()
    strange = found.join(known, "subject", "left_anti").agg(F.count(F.lit(1)).alias("strange_subjects")).withColumn("_one", F.lit(1))
    sums = both.agg(F.count_if(F.col("text").isNotNull() | F.col("_rows").isNull()).alias("_a"), F.count(F.lit(1)).alias("posts"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"), F.count_if(F.col("_rows").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) == "")).alias("blank_with_subject"), F.count_if(F.col("_rows") != F.col("_subjects")).alias("twice"), F.count_if((F.col("_least") < subjects.CUTOFF) | (F.col("_most") > 1)).alias("out_of_range"))
    return sums.drop("_a").withColumn("_one", F.lit(1)).join(strange, "_one").drop("_one")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sorted(r["subject"] for r in read(spark, sf_dir, "subjects").select("subject").where("subject IS NOT NULL").distinct().collect())  # the fixed list of areas
    return subjects.classify(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "subject_labels"), "doc_id", "subject", "rater", names)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).select("doc_id", "subject").distinct()


def p10_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and characters by subject; a post with two subjects counts for both."""
    found = p10_found(spark, sf_dir)
    texts = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return texts.join(found, "doc_id", "left").groupBy(F.coalesce("subject", F.lit("none")).alias("subject")).agg(F.count(F.lit(1)).alias("posts"), F.sum("chars").alias("chars"))


QUERIES = {name: globals()[name] for name in ("p2_found", "p2_nearest", "p4_found", "p4_cutoffs", "p8_ids", "p8_check", "p9_pack", "p9_fill", "p9_check", "p10_found", "p10_makeup", "p10_check")}

HELD = """
held AS (SELECT * FROM engine QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY scored_ts DESC) = 1),
fin AS (SELECT * FROM held WHERE isfinite(score)),
pos AS (SELECT f.*, target_pct, n_candidates, n_selected, count(*) OVER (PARTITION BY f.run_id, f.cohort) AS n, rank() OVER (PARTITION BY f.run_id, f.cohort ORDER BY score DESC) AS r FROM fin f JOIN backtest_cohorts b ON b.run_id = f.run_id AND b.cohort = f.cohort)
"""

SQL = {
    "p2_found": """WITH ev AS (SELECT DISTINCT event_id, code, tradable_ts FROM event_panel WHERE tradable_ts IS NOT NULL)
SELECT event_id, liq_id FROM ev JOIN liquidity l ON l.code = ev.code AND l.float_mcap IS NOT NULL AND l.date BETWEEN tradable_ts - INTERVAL 36 HOUR AND tradable_ts + INTERVAL 36 HOUR
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(tradable_ts) - epoch_us(l.date)), l.date, liq_id) = 1""",
    "p2_nearest": """WITH ev AS (SELECT DISTINCT event_id, code, tradable_ts FROM event_panel WHERE tradable_ts IS NOT NULL)
SELECT event_id, liq_id, (epoch_us(l.date) - epoch_us(tradable_ts)) / 1e6 AS distance_s, float_mcap FROM ev JOIN (SELECT DISTINCT * FROM liquidity) l ON l.code = ev.code AND l.float_mcap IS NOT NULL AND l.date BETWEEN tradable_ts - INTERVAL 36 HOUR AND tradable_ts + INTERVAL 36 HOUR
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(tradable_ts) - epoch_us(l.date)), l.date, liq_id) = 1""",
    "p8_check": "SELECT count(*) AS documents, 0 AS missing, 0 AS unequal FROM documents",
    "p9_check": "SELECT count(*) AS posts, 0 AS missing, 0 AS unknown, 0 AS other_size, 0 AS split_needlessly, 0 AS over_full FROM documents",
    "p10_check": "SELECT count(*) AS posts, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars, 0 AS blank_with_subject, 0 AS twice, 0 AS out_of_range, 0 AS strange_subjects FROM documents",
    "p4_found": f"WITH {HELD} SELECT cand_id FROM pos WHERE r <= greatest(1, ceil(n * target_pct / 100.0))",
    "p4_cutoffs": f"""WITH {HELD},
k AS (SELECT run_id, cohort, any_value(target_pct) AS target_pct, min(score) AS cutoff, any_value(n) AS n_scored, count(*) AS n_kept, any_value(n_candidates) AS n_candidates, any_value(n_selected) AS n_selected FROM pos WHERE r <= greatest(1, ceil(n * target_pct / 100.0)) GROUP BY run_id, cohort)
SELECT *, n_scored = n_candidates AND n_kept = n_selected AS counts_agree FROM k""",
}
