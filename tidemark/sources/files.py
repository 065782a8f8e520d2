"""Panels and results as files."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, is_dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import storage


@dataclass(frozen=True)
class Settings:
    """The parameters of a study; their fingerprint goes with its results."""

    horizons: tuple[int, ...] = (1, 5, 10, 20, 40, 60)
    lag: int = 4
    window: int = 8
    least: int = 4
    top: float = 0.2
    aum: float = 1e8
    purge_days: int = 60
    extra: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def fingerprint(self) -> str:
        return sha256(self.to_json().encode()).hexdigest()[:16]


def save_panel(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load_panel(spark: SparkSession, path: str) -> DataFrame:
    if not storage.exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def save_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for result tables of a bounded size."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """None if the file is missing or empty."""
    if not storage.exists(spark, path) or spark.read.text(path).isEmpty():
        return None
    return spark.read.schema(schema).option("header", True).csv(path)


def save_json(spark: SparkSession, value: object, path: str) -> None:
    storage.write_text(spark, path, json.dumps(asdict(value) if is_dataclass(value) else value, ensure_ascii=False, indent=1, default=str))


def load_json(spark: SparkSession, path: str) -> object | None:
    text = storage.read_text(spark, path)
    return json.loads(text) if text else None


def markdown_table(headers: list[str], rows: list[tuple]) -> str:
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = [headers, ["---"] * len(headers), *rows]
    return "\n".join("| " + " | ".join(map(cell, line)) + " |" for line in lines)
