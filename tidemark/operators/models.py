"""Walk-forward models on panels: splits by date with a purge gap, train-only scaling, linear, boosted and neural regressors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

#: Prefixes and names of columns that are no features.
NOT_FEATURES = ("event_id", "code", "name", "industry", "cohort", "fwd_ret", "exit_", "ret_", "entry_", "is_", "report_date", "tradable")


def feature_columns(df: DataFrame, allowed: list[str] | None = None) -> list[str]:
    """Numeric columns that aren't identifiers, dates or outcomes."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    able = [c for c, k in df.dtypes if (k in numeric or k.startswith("decimal")) and not c.startswith(NOT_FEATURES)]
    if allowed is None:
        return able
    wrong = [c for c in allowed if c.startswith(NOT_FEATURES)]
    if wrong:
        raise ValueError(f"not features: {', '.join(wrong)}")
    return [c for c in allowed if c in df.columns]


def blocks(df: DataFrame, date: str, n: int, name: str = "block") -> DataFrame:
    """The block 0..n-1 of each row: the distinct dates in order, cut as evenly as possible, earlier blocks larger."""
    dates = df.where(F.col(date).isNotNull()).select(date).distinct()
    total = dates.count()  # one row per date
    ranked = dates.withColumn("_r", F.row_number().over(Window.orderBy(date)) - 1)
    size, more = divmod(total, n)
    edge = more * (size + 1)
    block = F.when(F.col("_r") < edge, F.floor(F.col("_r") / (size + 1))).otherwise(more + F.floor((F.col("_r") - edge) / max(size, 1)))
    return df.join(ranked.select(date, block.cast("int").alias(name)), date)


def fold_table(df: DataFrame, date: str, n: int = 5, purge_days: int = 0, least_share: float = 0.3) -> DataFrame:
    """(fold, test_start, test_end, test_rows, train_rows) per block but the first, from one count per date.

    Training rows lie more than ``purge_days`` before the block's first date. A fold with fewer training rows than
    ``least_share`` of all rows, those without a date included, is left out.
    """
    if n < 2:
        raise ValueError("n must be at least 2")
    dated = settle(df.groupBy(date).agg(F.count(F.lit(1)).alias("_n")))  # one row per date
    tests = blocks(dated, date, n).where("block > 0").groupBy("block").agg(F.min(date).alias("a"), F.max(date).alias("z"), F.sum("_n").alias("n"))
    total = dated.agg(F.sum("_n")).first()[0] or 0
    day = lambda x: F.lit(str(x)).cast("date")
    marks = [F.struct(F.lit(r["block"]).alias("fold"), day(r["a"]).alias("test_start"), day(r["z"]).alias("test_end"), F.lit(r["n"]).cast("bigint").alias("test_rows")) for r in tests.collect()]  # fewer than n rows
    if not marks:
        return df.sparkSession.createDataFrame([], "fold int, test_start date, test_end date, test_rows bigint, train_rows bigint")
    seen = dated.select(date, "_n", F.explode(F.array(*marks)).alias("_f")).select(date, "_n", "_f.*")
    train = F.coalesce(F.sum(F.when(F.col(date) < F.date_sub("test_start", purge_days), F.col("_n"))), F.lit(0))
    return seen.groupBy("fold", "test_start", "test_end", "test_rows").agg(train.alias("train_rows")).where(F.col("train_rows") >= least_share * total)


def folds(df: DataFrame, date: str, n: int = 5, purge_days: int = 0, least_share: float = 0.3) -> list[tuple[DataFrame, DataFrame]]:
    """(train, test) of each row of ``fold_table``."""
    day = lambda x: F.lit(str(x)).cast("date")
    spans = fold_table(df, date, n, purge_days, least_share).orderBy("fold").collect()  # n rows at most
    return [(df.where(F.col(date) < F.date_sub(day(r["test_start"]), purge_days)), df.where(F.col(date).between(day(r["test_start"]), day(r["test_end"])))) for r in spans]


@dataclass
class Scaler:
    """Medians, means and deviations of the training rows."""

    columns: list[str]
    median: list[float]
    mean: list[float]
    std: list[float]

    @staticmethod
    def fit(train: DataFrame, columns: list[str]) -> Scaler:
        medians = train.agg(*[F.percentile(c, 0.5) for c in columns]).first()
        median = [0.0 if m is None else float(m) for m in medians]
        filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(m)).alias(c) for c, m in zip(columns, median)])
        stats = filled.agg(*[F.avg(c) for c in columns], *[F.stddev_samp(c) for c in columns]).first()
        k = len(columns)
        return Scaler(columns, median, [float(x or 0) for x in stats[:k]], [float(x) if x else 1.0 for x in stats[k:]])

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"_z_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(m)) - a) / s for c, m, a, s in zip(self.columns, self.median, self.mean, self.std)})


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=[f"_z_{c}" for c in columns], outputCol="_x").transform(df)


def fit_linear(rows: DataFrame, target: str, alpha: float = 0.0):
    """Ordinary or ridge least squares on ``_x``; ``alpha`` penalises the squared weights of the plain sum of squares."""
    if alpha <= 0:
        return LinearRegression(featuresCol="_x", labelCol=target, solver="normal", standardization=False).fit(rows)
    n, spread = rows.agg(F.count(F.lit(1)), F.stddev_pop(target)).first()
    return LinearRegression(featuresCol="_x", labelCol=target, solver="normal", standardization=False, elasticNetParam=0.0, regParam=alpha / n * (spread or 1.0)).fit(rows)


def fit_boosted(rows: DataFrame, target: str, trees: int = 300, rate: float = 0.05, depth: int = 4):
    return GBTRegressor(featuresCol="_x", labelCol=target, maxIter=trees, stepSize=rate, maxDepth=depth, seed=42).fit(rows)


@dataclass
class Net:
    """Two hidden layers of rectified units."""

    weights: list[np.ndarray]

    def predict(self, x: np.ndarray) -> np.ndarray:
        for i in range(0, len(self.weights), 2):
            x = x @ self.weights[i] + self.weights[i + 1]
            if i + 2 < len(self.weights):
                x = np.maximum(x, 0)
        return x[:, 0]


def net_slope(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The gradient of the sum of squared errors over the rows, per weight array."""
    acts = [x]
    for i in range(0, len(weights), 2):
        z = acts[-1] @ weights[i] + weights[i + 1]
        acts.append(np.maximum(z, 0) if i + 2 < len(weights) else z)
    d, out = (acts[-1][:, 0] - y)[:, None] * 2, []
    for layer in range(len(weights) // 2 - 1, -1, -1):
        out = [acts[layer].T @ d, d.sum(0), *out]
        d = (d @ weights[2 * layer].T) * (acts[layer] > 0)
    return out


def fit_net(rows: DataFrame, columns: list[str], target: str, hidden: tuple[int, ...] = (64, 32), epochs: int = 60, rate: float = 0.01) -> Net:
    """Trained by full-batch Adam; each partition works out the gradient of its rows, which is of the size of the net whatever their number.

    A NULL, NaN or infinite value in a column or the target is refused with ValueError, as is a table without rows.
    """
    numbers = [F.col(c).cast("double") for c in [*columns, target]]
    held = settle(rows.select(F.array(*numbers[:-1]).alias("x"), numbers[-1].alias("y")))
    bad = F.count_if(F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | F.col("y").isNull() | F.isnan("y") | (F.abs("y") == float("inf")))
    n, wrong = held.agg(F.count(F.lit(1)), bad).first()
    if wrong or not n:
        raise ValueError("missing values" if wrong else "no rows")
    rng = np.random.default_rng(42)
    sizes, ws = [len(columns), *hidden, 1], []
    for a, b in zip(sizes, sizes[1:]):
        ws += [rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)]
    context = rows.sparkSession.sparkContext
    m, v = [np.zeros_like(w) for w in ws], [np.zeros_like(w) for w in ws]
    for t in range(1, epochs + 1):
        sent = context.broadcast(ws)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                x = np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, -1)
                part = net_slope(sent.value, x, np.asarray(batch.column("y"), float))  # noqa: B023
                total = part if total is None else [a + b for a, b in zip(total, part)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([g.ravel() for g in total], pa.list_(pa.float64()))], names=["i", "g"])

        found = held.mapInArrow(work, "i int, g array<double>").select("i", F.posexplode("g").alias("k", "g")).groupBy("i", "k").agg(F.sum("g").alias("g")).collect()  # a row per weight
        sent.destroy()
        slopes = [np.zeros(w.size) for w in ws]
        for r in found:
            slopes[r["i"]][r["k"]] = r["g"] / n
        for i, g in enumerate(x.reshape(w.shape) for x, w in zip(slopes, ws)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            ws[i] = ws[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Net(ws)


def predict_net(df: DataFrame, net: Net, columns: list[str], name: str = "prediction") -> DataFrame:
    """``df`` with the net's prediction; NULL where a column is missing."""
    sent = df.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def predicted(x: pd.Series) -> pd.Series:
        return pd.Series(sent.value.predict(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

    x = F.array(*[F.col(c).cast("double") for c in columns])
    whole = ~F.exists(x, lambda v: v.isNull())
    filled = F.transform(x, lambda v: F.coalesce(v, F.lit(0.0)))
    return df.withColumn(name, F.when(whole, predicted(filled)))


def walk_forward(df: DataFrame, columns: list[str], target: str, date: str, model: str = "ridge", n: int = 5, purge_days: int = 60, alpha: float = 1.0, trees: int = 300) -> DataFrame:
    """Out-of-sample predictions (event_id, fold, prediction) of each fold's model on its test block."""
    out = None
    df = settle(df)
    for fold, (train, test) in enumerate(folds(df.where(F.col(target).isNotNull()), date, n, purge_days)):
        scaler = Scaler.fit(train, columns)
        rows = _vectors(scaler.apply(train), columns)
        fitted = fit_boosted(rows, target, trees) if model == "boosted" else fit_linear(rows, target, alpha if model == "ridge" else 0.0)
        part = fitted.transform(_vectors(scaler.apply(test), columns)).select("event_id", F.lit(fold + 1).alias("fold"), "prediction")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no fold has enough training rows")
    return out


def importance(model, columns: list[str]) -> list[tuple[str, float]]:
    """Features by weight, heaviest first."""
    values = model.featureImportances if hasattr(model, "featureImportances") else np.abs(model.coefficients.toArray())
    return sorted(((c, float(values[i])) for i, c in enumerate(columns)), key=lambda p: (-p[1], p[0]))


def scorable(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which at least half of the features are present."""
    present = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return df.where(present * 2 >= len(columns))


def matured(df: DataFrame, exit_date: str, cutoff: str, least: int = 200) -> DataFrame:
    """Rows whose outcome was known by ``cutoff``; ValueError if fewer than ``least``."""
    out = df.where(F.col(exit_date) <= F.lit(cutoff).cast("date"))
    if out.limit(least).count() < least:
        raise ValueError("too few matured rows")
    return out
