"""A store of fetched tables on the session's file system: one parquet table per request, notes on where each came from, bulk fetching, a breaker.

    root/<interface>/<request>/     the table
    root/_notes/*.json              one note per request, read together as the listing
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import storage

NOTE = "interface string, params string, rows bigint, version string, fetched_at string, sha256 string, columns array<string>"
#: How much of a request can be read in its name, and the digits of the hash that tells requests apart.
READABLE, DIGITS = 60, 12


class SourceError(RuntimeError):
    """A source that failed after all its tries."""


@dataclass(frozen=True)
class Request:
    interface: str
    params: dict = field(default_factory=dict)

    @property
    def text(self) -> str:
        """The parameters in one spelling, whatever their order."""
        return json.dumps(self.params, sort_keys=True, ensure_ascii=False, default=str)

    @property
    def name(self) -> str:
        values = "_".join(str(self.params[k]) for k in sorted(self.params))
        mark = sha256(f"{self.interface} {self.text}".encode()).hexdigest()[:DIGITS]
        return re.sub("[^0-9A-Za-z]+", "_", values)[:READABLE].strip("_") + "." + mark


def columnar(frame: pd.DataFrame) -> pa.Table:
    """A column that holds values of several kinds, which no one type fits, becomes text; so does one without any value."""

    def column(values: pd.Series) -> pa.Array:
        try:
            found = pa.array(values, from_pandas=True)
            if not pa.types.is_null(found.type):
                return found
        except (pa.ArrowInvalid, pa.ArrowTypeError):
            pass
        return pa.array([None if pd.isna(v) else str(v) for v in values], pa.string())

    return pa.table({str(name): column(frame[name]) for name in frame.columns})


class Store:
    """Tables by request. ``root`` must be a place that the executors reach too."""

    def __init__(self, spark: SparkSession, root: str, tries: int = 4, backoff: float = 1.5, sleep: Callable[[float], None] = time.sleep):
        self.spark, self.root, self.tries, self.backoff, self.sleep = spark, root.rstrip("/"), max(1, tries), backoff, sleep

    def get(self, interface: str, params: dict | None = None, call: Callable[..., pd.DataFrame] | None = None, force: bool = False, version: str = "") -> DataFrame:
        """The stored table of a request, fetched first if it isn't there or ``force`` is set."""
        request = Request(interface, params or {})
        table = f"{self.root}/{interface}/{request.name}"
        if force or not storage.exists(self.spark, f"{table}/_SUCCESS"):
            if call is None:
                raise SourceError(f"{interface} isn't stored and there is nothing to call")
            self._keep(request, table, columnar(self._asked(request, call)), version)
        return self.spark.read.parquet(table)

    def _asked(self, request: Request, call: Callable[..., pd.DataFrame]) -> pd.DataFrame:
        waits = [self.backoff**n for n in range(1, self.tries)]
        for wait in [*waits, None]:
            try:
                return call(**request.params)
            except Exception as error:  # a source can fail in any way
                if wait is None:
                    raise SourceError(f"{request.interface}: {error}") from error
            self.sleep(wait)
        raise AssertionError

    def _keep(self, request: Request, table: str, found: pa.Table, version: str) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, found.schema) as writer:
            writer.write_table(found)
        self.spark.createDataFrame(found).coalesce(1).write.mode("overwrite").parquet(table)
        note = dict(interface=request.interface, params=request.text, rows=found.num_rows, version=version, fetched_at=datetime.now(timezone.utc).isoformat(), sha256=sha256(sink.getvalue()).hexdigest(), columns=found.column_names)
        storage.write_text(self.spark, f"{self.root}/_notes/{request.interface}.{request.name}.json", json.dumps(note, ensure_ascii=False))

    def listing(self) -> DataFrame:
        """The notes as a table; unreadable ones are left out."""
        if not storage.exists(self.spark, f"{self.root}/_notes"):
            return self.spark.createDataFrame([], NOTE)
        rows = self.spark.read.schema(NOTE + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(f"{self.root}/_notes")
        return rows.where(F.col("_corrupt_record").isNull() & F.col("interface").isNotNull()).drop("_corrupt_record")


class Breaker:
    """Opens for good after so many failures in a row."""

    def __init__(self, most: int = 3):
        self.most, self.failures, self.open = most, 0, False

    def report(self, ok: bool) -> None:
        self.failures = 0 if ok else self.failures + 1
        self.open = self.open or self.failures >= self.most


def fallback(calls: list[Callable[[], DataFrame]], breakers: list[Breaker] | None = None) -> DataFrame:
    """The first source that answers; sources whose breaker is open are passed over."""
    last: Exception | None = None
    for n, call in enumerate(calls):
        if breakers and breakers[n].open:
            continue
        try:
            out = call()
        except SourceError as error:
            last = error
            if breakers:
                breakers[n].report(False)
        else:
            if breakers:
                breakers[n].report(True)
            return out
    raise SourceError("no source answered") from last


def bulk(spark: SparkSession, codes: Iterable[str], call: Callable[[str], DataFrame], workers: int = 4) -> tuple[DataFrame | None, DataFrame]:
    """(the union of what was fetched, failures as code and error); the calls only wait for the network."""
    wanted = list(dict.fromkeys(codes))

    def one(code: str) -> tuple[str, DataFrame | None, str]:
        try:
            return code, call(code), ""
        except Exception as error:  # reported beside the data
            return code, None, f"{type(error).__name__}: {error}"

    with ThreadPoolExecutor(max_workers=workers) as pool:
        found = list(pool.map(one, wanted))
    union = None
    for _, df, _ in found:
        if df is not None:
            union = df if union is None else union.unionByName(df, allowMissingColumns=True)
    return union, spark.createDataFrame([(c, e) for c, df, e in found if df is None], "code string, error string")
