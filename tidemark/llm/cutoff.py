"""Score cutoffs that keep a target fraction of each source.

The records are sorted by source, score (best first) and identifier over ranges that cut through large sources and
through ties, and the counts of the ranges give each record's exact position in its source. The score at the target
position is the cutoff; everything that scores as much is kept.

Defined cases: NULL, NaN and infinite scores don't count; of an id scored again the latest holds (NULL time first, then
the greater score); sources without a target, or with a NULL one, keep nothing; a target of 0 keeps the best score and its
ties; one over 100 keeps all; 0.0 and -0.0 are equal; an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sequence import offsets, ordered
from tidemark.session import finite


def holding_scores(rows: DataFrame, keys: list[str], ident: str, score: str, scored_at: str) -> DataFrame:
    """(keys, ident, score): one row per identifier with a finite holding score."""
    latest = F.max(F.struct(F.col(scored_at).alias("_t"), F.col(score).alias("_s"), *keys)).alias("_held")
    held = rows.where(F.col(ident).isNotNull()).groupBy(ident).agg(latest).select(*[F.col(f"_held.{k}").alias(k) for k in keys], ident, (finite(F.col("_held._s")) + 0.0).alias(score))
    return held.where(F.col(score).isNotNull())


def cutoffs(scores: DataFrame, targets: DataFrame, keys: list[str], ident: str, score: str, target_pct: str) -> tuple[DataFrame, DataFrame]:
    """(kept rows, report). The report has keys, n_scored, cutoff, n_kept for each source with scores and a target.

    ``scores`` comes from ``holding_scores``; ``targets`` has one row per source. Positions are exact: the target is the least
    count of at least ``target_pct`` percent.
    """
    ranked = ordered(scores, keys, [F.col(score).desc(), F.col(ident)])
    parts = offsets(ranked, keys)
    wanted = targets.where(F.col(target_pct).isNotNull()).select(*keys, F.col(target_pct).cast("decimal(20,6)").alias("_pct"))
    aim = F.least(F.greatest(F.ceil(F.col("_all") * F.col("_pct") / 100), F.lit(1)), F.col("_all")).cast("bigint")
    aimed = parts.join(wanted, keys).withColumn("_k", aim)
    # the record at the target position, named by its place in its range
    marks = aimed.where("_before < _k AND _k <= _before + _here").select(*keys, (F.col("_first") + F.col("_k") - 1 - F.col("_before")).alias("_mid"), F.col("_all").alias("n_scored"))
    cut = ranked.join(marks, [*keys, "_mid"]).select(*keys, F.col(score).alias("cutoff"), "n_scored")
    # a source's cutoff reaches its rows through its ranges, so a large source isn't gathered
    reach = parts.select(*keys, "_part").join(cut, keys)
    kept = ranked.join(reach, [*keys, "_part"]).where(F.col(score) >= F.col("cutoff"))
    sizes = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_kept"))
    return kept.select(*keys, ident, score, "cutoff"), cut.join(sizes, keys).select(*keys, "n_scored", "cutoff", "n_kept")
