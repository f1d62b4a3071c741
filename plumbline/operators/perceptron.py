"""Regression by a multilayer perceptron, for all folds at once, on whole-table gradients.

A step is one pass: each task adds up, by model, the gradient of its rows that lie outside the model's fold, and sends one array of fixed size per
model; these are added up in the order of the tasks. Weights and the optimiser's moments stay on the driver: models x weights
numbers, whatever the number of rows. Features and the target are centred and scaled by the training rows' mean and deviation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.shared import written

#: Up to so many tasks' sums are added up by the driver, those of more by models in tasks. Numbers that the driver holds at most.
FEW_TASKS, MOST_NUMBERS = 16, 20_000_000
#: Rows whose layers stay in a core's cache.
AT_ONCE = 5000


def shapes(width: int, hidden: tuple[int, ...]) -> list[tuple[int, int]]:
    sizes = [width, *hidden, 1]
    return list(zip(sizes, sizes[1:]))


def begin(width: int, hidden: tuple[int, ...], seed: int) -> np.ndarray:
    """First weights and biases, one after another: normal draws of deviation sqrt(2 / inputs), and zeros."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.concatenate([rng.normal(0, np.sqrt(2 / a), a * b), np.zeros(b)]) for a, b in shapes(width, hidden)])


def _layers(weights: np.ndarray, width: int, hidden: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in shapes(width, hidden):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _forward(weights: np.ndarray, x: np.ndarray, hidden: tuple[int, ...]) -> list[np.ndarray]:
    """As ``forward``, with a column for each row: long inner loops."""
    out, layers = [x], _layers(weights, len(x), hidden)
    for i, (w, b) in enumerate(layers):
        z = w.T @ out[-1]
        z += b[:, None]
        out.append(z if i == len(layers) - 1 else np.maximum(z, 0, out=z))
    return out


def forward(weights: np.ndarray, x: np.ndarray, hidden: tuple[int, ...]) -> list[np.ndarray]:
    """The input and what each layer puts out; all but the last are cut at 0."""
    return [v.T for v in _forward(weights, x.T, hidden)]


def gradient(weights: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: tuple[int, ...], counts: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Gradient and value of half the sum of squared errors, over the rows that count."""
    out = _forward(weights, x.T, hidden)
    miss = out[-1][0] - y
    if counts is not None:
        miss *= counts
    back, parts = miss[None, :], []
    layers = _layers(weights, x.shape[1], hidden)
    for i in range(len(layers) - 1, -1, -1):
        if i < len(layers) - 1:
            back *= out[i + 1] > 0
        parts.append(np.concatenate([(out[i] @ back.T).ravel(), back.sum(1)]))
        if i:
            w = layers[i][0]
            back = w * back if w.shape[1] == 1 else w @ back
    return np.concatenate(parts[::-1]), float(miss @ miss) / 2


def cross_fit_perceptron(
    df: DataFrame, fold: str, features: list[str], y: str, hidden: tuple[int, ...] = (32, 16), steps: int = 150, rate: float = 0.02, l2: float = 1e-4, seed: int = 42, name: str = "pred"
) -> DataFrame:
    """Adds the prediction of the model of the rows with another fold: ``steps`` Adam steps on the mean squared error / 2 + l2 / 2 * squared weights.

    Rows with a NULL feature or fold have no prediction and are not learnt from, nor are rows with a NULL y; a fold with no rows outside it has NULL
    predictions. A constant feature or target has deviation 1e-8 more. The same partitions give the same weights.
    """
    width, columns = len(features), df.columns
    x, v = [F.col(f).cast("double") for f in features], F.col(y).cast("double")
    own = df.dropna(subset=[*features, y, fold])
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate([*x, v])), *(F.sum(c * c).alias(f"q{i}") for i, c in enumerate([*x, v]))]
    rows = sorted(own.groupBy(fold).agg(*sums).collect(), key=lambda r: str(r[fold]))
    per = np.array([[r["n"], *(r[f"s{i}"] for i in range(width + 1)), *(r[f"q{i}"] for i in range(width + 1))] for r in rows], float).reshape(len(rows), 2 * width + 3)
    rest = per.sum(0) - per
    models = [i for i in range(len(rows)) if rest[i, 0] > 0]
    size = len(begin(width, hidden, seed))
    if len(models) * size * 4 > MOST_NUMBERS:
        raise ValueError(f"{len(models)} models of {size} weights")
    number = {rows[i][fold]: m for m, i in enumerate(models)}
    mean = np.array([rest[i, 1 : width + 2] / rest[i, 0] for i in models]).reshape(len(models), width + 1)
    scale = np.array([np.sqrt(np.maximum(rest[i, width + 2 :] / rest[i, 0] - mean[m] ** 2, 0)) + 1e-8 for m, i in enumerate(models)]).reshape(len(models), width + 1)
    numbers = df.sparkSession.createDataFrame(list(number.items()), f"_f {dict(df.dtypes)[fold]}, _m int")
    data = own.select(*(c.alias(f"_x{j}") for j, c in enumerate(x)), v.alias("_y"), F.col(fold).alias("_f")).join(F.broadcast(numbers), "_f", "left")  # a row a model
    data = written(data.select(*(f"_x{j}" for j in range(width)), "_y", F.coalesce("_m", F.lit(-1)).alias("_m")), "rows")
    weights = np.array([begin(width, hidden, seed + m) for m in range(len(models))]).reshape(len(models), size)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    tasks = data.rdd.getNumPartitions()
    for t in range(1, steps + 1 if models else 1):
        total = _pass(data, tasks, weights, mean, scale, hidden, width)
        g = total[:, 1:] / total[:, :1] + l2 * weights
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        weights = weights - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.stack([batch.column(f"_x{j}").to_numpy(zero_copy_only=False).astype(float) for j in range(width)], 1)
            model = np.array([number.get(f, -1) for f in batch.column("_f").to_pylist()], np.int64)
            out = np.full(len(batch), np.nan)
            for m in np.unique(model[model >= 0]).tolist():
                at = np.flatnonzero((model == m) & ~np.isnan(v).any(1))
                out[at] = forward(weights[m], (v[at] - mean[m, :-1]) / scale[m, :-1], hidden)[-1][:, 0] * scale[m, -1] + mean[m, -1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, from_pandas=True)], names=[*columns, name])

    wide = df.select("*", *(c.alias(f"_x{j}") for j, c in enumerate(x)), F.col(fold).alias("_f"))
    return wide.mapInArrow(score, ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{name}` double"]))


def _pass(data: DataFrame, tasks: int, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray, hidden: tuple[int, ...], width: int) -> np.ndarray:
    """Per model the rows and the gradient of the rows outside its fold."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(weights), weights.shape[1] + 1))
        for batch in batches:
            x, y = np.stack([batch.column(f"_x{j}").to_numpy() for j in range(width)]), batch.column("_y").to_numpy()
            model = batch.column("_m").to_numpy()
            for a in range(0, len(batch), AT_ONCE):
                part = slice(a, a + AT_ONCE)
                for m in range(len(weights)):
                    counts = model[part] != m
                    z = (x[:, part] - mean[m, :-1, None]) / scale[m, :-1, None]
                    g, _ = gradient(weights[m], z.T, (y[part] - mean[m, -1]) / scale[m, -1], hidden, counts)
                    total[m, 0] += counts.sum()
                    total[m, 1:] += g
        task = TaskContext.get().partitionId()
        cols = [pa.array(range(len(total)), pa.int32()), pa.array([task] * len(total), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["model", "task", "sums"])

    def together(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("task")
        total = sum(np.frombuffer(v.as_py(), float) for v in parts.column("sums"))
        return pa.table({"model": parts.column("model")[:1], "task": parts.column("task")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "model int, task int, sums binary"
    parts = data.mapInArrow(add, schema)
    if tasks > FEW_TASKS:
        parts = parts.withColumn("salt", F.floor(F.col("task") / 64).cast("int")).groupBy("model", "salt").applyInArrow(lambda t: together(t.drop_columns("salt")), schema)
        parts = parts.groupBy("model").applyInArrow(together, schema)
    out = np.zeros((len(weights), weights.shape[1] + 1))
    for r in sorted(parts.collect(), key=lambda r: (r["model"], r["task"])):  # one array of fixed size for each model, of a few tasks at most
        out[r["model"]] += np.frombuffer(r["sums"], float)
    return out
