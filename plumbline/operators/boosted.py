"""Gradient boosting of all folds at once, on histograms.

A fold's model learns from the rows outside the fold. Features are cut into bins once, at quantiles. Rows lie in the shared folder with
the sum of the trees so far of every model; a level of all models' trees is one pass: each task adds up, by (model, node, feature, bin), gradients and
rows, and sends one table per model, which are added up. A fold's own rows are left out where the table is
made. The driver sees models x nodes x features x bins numbers, whatever the number of rows, and picks all splits.

Gradients are added as whole numbers (2^-22 of the target's range), so a sum does not depend on its order: trees are the same on any cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ranking import quantiles
from plumbline.shared import drop, stored

BINS = 64
#: Trees that rows are led through anew in each pass, before their sums are written.
KEEP_EVERY = 10
#: Up to so many tasks' tables are added up by the driver, those of more by models in tasks.
FEW_TASKS = 8
#: Numbers of one level's tables that the driver holds: with more, use fewer folds at once, bins or levels.
MOST_CELLS = 50_000_000
ONE = float(1 << 22)


class Tree(NamedTuple):
    """Nodes of a model's tree by level: feature (-1: a leaf), bin (rows of this bin or below go left) and value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1))):
            f = self.feature[at]
            down = bins[np.arange(len(bins)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(f < 0, at, 2 * at + 1 + down)
        return at


def grow(tables: np.ndarray, nodes: list[int], tree: Tree, rate: float, l2: float, least: int, min_gain: float) -> list[int]:
    """Splits a model's nodes by (node, feature, bin, [gradient, rows]) and sets their children's values; the children.

    The gain of a split is gl^2 / (nl + l2) + gr^2 / (nr + l2) - g^2 / (n + l2); ties go to the first feature, then the smallest bin.
    """
    after = []
    value = lambda g, n: rate * g / (n + l2) if n else 0.0
    for i, node in enumerate(nodes):
        g, n = tables[i, 0, :, 0].sum() / ONE, tables[i, 0, :, 1].sum()
        tree.value[node] = value(g, n)
        if n < 2 * least:
            continue
        left = np.cumsum(tables[i], axis=1)[:, :-1].astype(float)
        gl, nl = left[..., 0] / ONE, left[..., 1]
        gr, nr = g - gl, n - nl
        gain = gl * gl / (nl + l2) + gr * gr / (nr + l2) - g * g / (n + l2)
        gain = np.where((nl >= least) & (nr >= least), gain, -np.inf)
        f, b = divmod(int(gain.argmax()), gain.shape[1])
        if gain[f, b] > min_gain:
            tree.feature[node], tree.cut[node] = f, b
            tree.value[2 * node + 1], tree.value[2 * node + 2] = value(gl[f, b], nl[f, b]), value(gr[f, b], nr[f, b])
            after += [2 * node + 1, 2 * node + 2]
    return after


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Inner edges of each feature's bins: its distinct quantiles."""
    out = []
    for f in features:
        r = quantiles(df, [], f, [i / bins for i in range(1, bins)]).first()
        out.append(np.unique(np.array(r["q"], float)) if r else np.zeros(0))
    return out


class Boosted(NamedTuple):
    """Models by (keys, fold): where each starts, and its trees; ``edges`` are the bins."""

    models: list[tuple]
    start: np.ndarray
    trees: list[list[Tree]]
    edges: list[np.ndarray]


def cross_fit_boosting(
    df: DataFrame, fold: str, features: list[str], y: str, rounds: int = 60, depth: int = 5, rate: float = 0.05, l2: float = 1.0, least: int = 1, min_gain: float = 1e-9,
    bins: int = BINS, keys: tuple[str, ...] = (), name: str = "pred",
) -> DataFrame:
    """Adds the prediction of the model of the rows with the same ``keys`` and another fold: least-squares boosting from their mean.

    A NULL feature lies in the first bin. Rows with a NULL y are predicted and not learnt from; rows with a NULL fold or key have no prediction, as
    do rows of a fold with no rows outside it. The result reads a table in the shared folder.
    """
    fitted, rows, width = fit_boosting(df, fold, features, y, rounds, depth, rate, l2, least, min_gain, bins, keys)
    if not fitted.models:
        return df.withColumn(name, F.lit(None).cast("double"))
    columns = df.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, x = _bins_of(batch, width)
            out = np.full(len(model), np.nan)
            for m in np.unique(model[model >= 0]).tolist():
                own, done = np.flatnonzero(model == m), len(fitted.trees[m]) // KEEP_EVERY * KEEP_EVERY
                out[own] = _sums(batch, own)[:, fitted.models[m][-1]] + sum(t.value[t.leaf(x[own])] for t in fitted.trees[m][done:])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, from_pandas=True)], names=[*columns, name])

    return rows.mapInArrow(score, ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{name}` double"]))


def _bins_of(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's own model (-1: none) and bins."""
    model = batch.column("_model").to_numpy()
    return model, np.frombuffer(b"".join(batch.column("_bins").to_pylist()), np.uint8).reshape(len(model), width)


def _sums(batch: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
    """Of rows of one key, the sums of the trees so far by model."""
    return batch.column("_sums").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def fit_boosting(df, fold, features, y, rounds, depth, rate, l2, least, min_gain, bins, keys) -> tuple[Boosted, DataFrame, int]:
    """The models, and the rows with the sums of their trees (all but the last ``len % KEEP_EVERY``) under ``_sums``.

    A model's last entry is its place in ``_sums``, which has one number for each fold of a row's key.
    """
    spark, keys = df.sparkSession, list(keys)
    known = df.dropna(subset=[fold, *keys])
    edges = bin_edges(df, features, bins)
    own = known.groupBy(*keys, fold).agg(F.count(y).alias("n"), F.sum(F.col(y).cast("double")).alias("s"), F.min(F.col(y).cast("double")).alias("lo"), F.max(F.col(y).cast("double")).alias("hi")).collect()
    own.sort(key=lambda r: tuple(map(str, (*(r[k] for k in keys), r[fold]))))
    groups: dict[tuple, list] = {}
    for r in own:
        groups.setdefault(tuple(r[k] for k in keys), []).append(r)
    models, start = [], []
    for at, folds in groups.items():
        n, s = sum(r["n"] for r in folds), sum(r["s"] or 0.0 for r in folds)
        for i, r in enumerate(folds):
            models.append((*at, r[fold], i))
            start.append((s - (r["s"] or 0.0)) / (n - r["n"]) if n > r["n"] else np.nan)
    start = np.array(start)
    trees: list[list[Tree]] = [[] for _ in models]
    fitted = Boosted(models, start, trees, edges)
    if not models:
        return fitted, df, len(features)
    values = [r["hi"] - r["lo"] for r in own if r["n"]] + [abs(v) for r in own if r["n"] for v in (r["hi"], r["lo"])]
    unit = ONE / max(max(values, default=1.0), 1e-300)
    number = {m[:-1]: i for i, m in enumerate(models)}
    first_of = {at: number[(*at, folds[0][fold])] for at, folds in groups.items()}
    count_of = {at: len(folds) for at, folds in groups.items()}
    names, width = df.columns, len(features)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((len(batch), width), np.uint8)
            for j, f in enumerate(features):
                v = batch.column(f"_x{j}").to_numpy(zero_copy_only=False).astype(float)
                x[:, j] = np.where(np.isnan(v), 0, np.searchsorted(edges[j], v, side="left"))
            ids = list(zip(*(batch.column(c).to_pylist() for c in [*keys, fold])))
            model = [number.get(i, -1) for i in ids]
            sums = [start[first_of[i[:-1]] : first_of[i[:-1]] + count_of[i[:-1]]].tolist() if m >= 0 else [] for i, m in zip(ids, model)]
            cols = [*(batch.column(c) for c in names), pa.array(model, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()), batch.column("_y"), pa.array(sums, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "_model", "_bins", "_y", "_sums"])

    plain = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    schema = f"{plain}, _model int, _bins binary, _y double, _sums array<double>"
    made = df.withColumns({f"_x{j}": F.col(f).cast("double") for j, f in enumerate(features)} | {"_y": F.col(y).cast("double")})
    rows, path = stored(made.mapInArrow(begun, schema), "boosted")
    first = np.array([first_of[m[:-2]] for m in models])
    cells = len(models) * (1 << max(depth - 1, 0)) * width * bins * 2
    if cells > MOST_CELLS:
        raise ValueError(f"{len(models)} models with {cells} numbers in one level")
    tasks = rows.rdd.getNumPartitions()
    for t in range(rounds):
        size = (1 << (depth + 1)) - 1
        new = [Tree(np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size)) for _ in models]
        nodes = [[0] if np.isfinite(s) else [] for s in start]
        recent = [x[t // KEEP_EVERY * KEEP_EVERY :] for x in trees]
        for _ in range(depth):
            if any(nodes):
                got = _level(rows, tasks, new, nodes, recent, first, width, bins, unit)
                nodes = [grow(got[m], nodes[m], new[m], rate / unit * ONE, l2, least, min_gain) if nodes[m] else [] for m in range(len(models))]
        for m, tree in enumerate(new):
            trees[m].append(tree)
        if (t + 1) % KEEP_EVERY == 0:
            done = [x[-KEEP_EVERY:] for x in trees]

            def summed(batches: Iterator[pa.RecordBatch], done=done) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield _led(batch, done, first, width)

            more, at = stored(rows.mapInArrow(summed, schema), "boosted")
            drop(spark, [path])
            rows, path = more, at
    return fitted, rows, width


def _led(batch: pa.RecordBatch, done: list[list[Tree]], first: np.ndarray, width: int) -> pa.RecordBatch:
    """The batch with the values of more trees in its sums."""
    model, x = _bins_of(batch, width)
    out = [[]] * len(model)
    for m0, own in _by_key(model, model >= 0, first):
        sums = _sums(batch, own).copy()
        for k in range(sums.shape[1]):
            for tree in done[m0 + k]:
                sums[:, k] += tree.value[tree.leaf(x[own])]
        for i, v in zip(own.tolist(), sums.tolist()):
            out[i] = v
    cols = [pa.array(out, pa.list_(pa.float64())) if c == "_sums" else batch.column(c) for c in batch.schema.names]
    return pa.RecordBatch.from_arrays(cols, names=batch.schema.names)


def _by_key(model: np.ndarray, mask: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The first model of each key, and the rows of the key."""
    for m0 in np.unique(first[model[mask]]).tolist():
        yield m0, np.flatnonzero(mask & (first[np.maximum(model, 0)] == m0))


def _level(rows: DataFrame, tasks: int, new: list[Tree], nodes: list[list[int]], recent: list[list[Tree]], first: np.ndarray, width: int, bins: int, unit: float) -> list[np.ndarray]:
    """Per model (node, feature, bin, [gradient, rows])."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {m: np.zeros((len(n), width, bins, 2), np.int64) for m, n in enumerate(nodes) if n}
        for batch in batches:
            model, x = _bins_of(batch, width)
            y = batch.column("_y").to_numpy(zero_copy_only=False).astype(float)
            for m0, group in _by_key(model, (model >= 0) & ~np.isnan(y), first):
                sums = _sums(batch, group)
                for m in range(m0, m0 + sums.shape[1]):
                    if not nodes[m]:
                        continue
                    learns = model[group] != m
                    at = group[learns]
                    pred = sums[learns, m - m0] + sum(t.value[t.leaf(x[at])] for t in recent[m])
                    place = np.full(len(new[m].feature), -1, np.int64)
                    place[nodes[m]] = np.arange(len(nodes[m]))
                    node = place[new[m].leaf(x[at])]
                    keep = node >= 0
                    gradient = np.rint((y[at][keep] - pred[keep]) * unit).astype(np.int64)
                    for j in range(width):
                        code = node[keep] * bins + x[at[keep], j]
                        flat = np.zeros((len(nodes[m]) * bins, 2), np.int64)
                        np.add.at(flat[:, 0], code, gradient)
                        flat[:, 1] = np.bincount(code, minlength=len(flat))
                        total[m][:, j] += flat.reshape(len(nodes[m]), bins, 2)
        task = TaskContext.get().partitionId()
        found = [(m, task, t.tobytes()) for m, t in total.items() if t.any()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 3, (pa.int32(), pa.int32(), pa.binary()))], names=["model", "task", "sums"])

    def together(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in parts.column("sums"))
        return pa.table({"model": parts.column("model")[:1], "task": parts.column("task")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "model int, task int, sums binary"
    parts = rows.select("_model", "_bins", "_y", "_sums").mapInArrow(add, schema)
    if tasks > FEW_TASKS:
        parts = parts.withColumn("salt", F.pmod("task", F.lit(64))).groupBy("model", "salt").applyInArrow(lambda t: together(t.drop_columns("salt")), schema)
        parts = parts.groupBy("model").applyInArrow(together, schema)
    out = [np.zeros((len(n), width, bins, 2), np.int64) for n in nodes]
    for r in parts.collect():  # a table of fixed size for each model, of a few tasks at most
        out[r["model"]] += np.frombuffer(r["sums"], np.int64).reshape(out[r["model"]].shape)
    return out
