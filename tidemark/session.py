"""Session helpers: the shared checkpoint folder and plan-time scalars."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def use_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session without that setting
    (tests) gets a folder of its own; a cluster without it is refused, as its executors share no temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder they start in.

    Executors that don't see that folder need the package installed or sent with ``--py-files``.
    """
    root, environment = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint; later reads see the same rows even if executors are lost."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_parts(spark: SparkSession) -> int:
    """Partitions for an explicit exchange: what the session asks of its own shuffles."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def finite(column: Column | str) -> Column:
    """A double with NaN and infinities as NULL."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def micros(column: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ or DATE, whatever the session's time zone."""
    c = (F.col(column) if isinstance(column, str) else column).cast("timestamp_ntz")
    seconds = F.unix_date(c.cast("date")).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def require_columns(df: DataFrame, names: list[str]) -> None:
    """Raise ValueError while the plan is built if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
