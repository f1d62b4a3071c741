"""Exact nearest neighbours in feature space: cells around pivots, and bounds that say which cells can still matter.

Training rows go to their nearest pivot. A pivot's rows are cut into rings by their distance to it, and a ring with too many rows (all at one
distance, say) into parts by key. A cell keeps the least and largest distance to its pivot and its rows. No row of a cell is nearer to a query than

* the query's distance to the pivot less the cell's largest one, or the cell's least one less the query's distance (triangle inequality);
* the half plane between the query's own pivot and the cell's allows (rows of a cell are nearer to its pivot than to any other).

Queries first meet the nearest cells that hold k rows together; the k-th distance found then rules out all other cells but those
whose bound lies below it, which they meet in a second round. Cells that hold only rows of the query's own part are never met. Pivots and cells are tables of a fixed size: at most ``MOST_PIVOTS`` and
about twice as many. The number of pairs grows with queries times the square root of the training rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.shared import written

MOST_PIVOTS, MOST_RINGS, LEAST_CELL = 2048, 64, 64
#: Up to so many training rows are one cell: an index would cost more than it saves.
ONE_CELL = 5_000
#: So many nearest cells are tried before all are put in order.
FEW = 16
#: Queries of one cell beyond this are dealt to several tasks; entries of a table of distances that is held at once.
QUERY_ROWS, AT_ONCE = 20_000, 250_000
#: Counts by cell and part that the driver may hold; with more, rows of the query's own part are counted in (and found missing later).
MOST_OWN = 1_000_000


class Cells(NamedTuple):
    """Pivots (one a row) and cells: pivot, rows, least and largest distance; ``own`` has the rows of a part in each cell."""

    pivots: np.ndarray
    pivot: np.ndarray
    n: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    own: dict[object, np.ndarray]

    def around(self, points: np.ndarray, parts: list, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(points x cells): no row is nearer, no row is farther, and the rows that do not belong to the point's part. ``between``: pivots' distances."""
        d = _distances(points, self.pivots)
        home = d.argmin(1)
        near, apart = d[np.arange(len(d)), home][:, None], between[home]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (d * d - near * near) / (2 * apart), 0.0)
        slack = 1e-9 * (1 + d.max(1, keepdims=True) + self.hi.max(initial=0.0))  # rounding must not lose a cell
        at = d[:, self.pivot]
        lower = np.maximum(np.maximum(at - self.hi, self.lo - at), plane[:, self.pivot])
        kinds = {p: i for i, p in enumerate(dict.fromkeys(parts))}
        left = np.stack([self.n - self.own[p] if p in self.own else self.n for p in kinds])[[kinds[p] for p in parts]]
        return np.maximum(lower - slack, 0.0), at + self.hi, left

    def first(self, upper: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
        """Mask of the nearest cells that hold k rows together. Few of the cells are needed, so all are put in order only where few do not hold k."""
        upper = np.where(left > 0, upper, np.inf)
        mask = np.zeros(upper.shape, bool)
        some = np.argpartition(upper, FEW, axis=1)[:, :FEW] if upper.shape[1] > 2 * FEW else None
        if some is not None:
            short = np.take_along_axis(left, some, 1).sum(1) < k
            order = np.take_along_axis(some, np.argsort(np.take_along_axis(upper, some, 1), axis=1, kind="stable"), 1)
            self._take(mask, left, order, k)
            if short.any():
                part = np.zeros((short.sum(), upper.shape[1]), bool)
                self._take(part, left[short], np.argsort(upper[short], axis=1, kind="stable"), k)
                mask[short] = part
        else:
            self._take(mask, left, np.argsort(upper, axis=1, kind="stable"), k)
        return mask & (left > 0)

    @staticmethod
    def _take(mask: np.ndarray, left: np.ndarray, order: np.ndarray, k: int) -> None:
        held = np.take_along_axis(left, order, 1)
        np.put_along_axis(mask, order, np.cumsum(held, axis=1) - held < k, 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        out += (a[:, f, None] - b[None, :, f]) ** 2
    return np.sqrt(out)


def _vectors(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(n: int, width: int) -> Iterator[slice]:
    step = max(1, AT_ONCE // max(width, 1))
    for a in range(0, n, step):
        yield slice(a, min(a + step, n))


def _homes(pivots: np.ndarray):
    """Adds the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch.column("_v"), pivots.shape[1])
            home, r = np.zeros(len(v), np.int32), np.zeros(len(v))
            for s in _blocks(len(v), len(pivots)):
                d = _distances(v[s], pivots)
                home[s] = d.argmin(1)
                r[s] = d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(r)], names=[*batch.schema.names, "_p", "_r"])

    return run


def first_of_each_place(rows: DataFrame, k: int, *place: str) -> DataFrame:
    """Of rows at one place the first k by ``_k``, in two steps so that no task holds a place of many rows."""
    salted = Window.partitionBy(*place, F.pmod(F.xxhash64("_k"), F.lit(64))).orderBy("_k")
    whole = Window.partitionBy(*place).orderBy("_k")
    some = rows.withColumn("_i", F.row_number().over(salted)).filter(F.col("_i") <= k)
    return some.withColumn("_i", F.row_number().over(whole)).filter(F.col("_i") <= k).drop("_i")


def build(rows: DataFrame, width: int, parts: bool, pivots: int | None = None) -> tuple[DataFrame, Cells]:
    """The rows (``_k``, ``_y``, ``_v``, ``_part``) with their ``_cell``, and the cells."""
    n = rows.count()
    if not pivots and n <= ONE_CELL:
        one = np.array([0], np.int64)
        return rows.withColumn("_cell", F.lit(0).cast("long")), Cells(np.zeros((1, width)), one, one + n, one * 0.0, one + np.inf, {})
    want = pivots or min(MOST_PIVOTS, max(1, math.isqrt(n)))
    drawn = rows.select("_v", F.xxhash64("_k").alias("_h")).orderBy("_h").limit(want).collect()
    points = np.unique(np.array([r["_v"] for r in drawn], float).reshape(-1, width), axis=0)
    homes = written(rows.mapInArrow(_homes(points), _with(rows, "_p int, _r double")), "homes")
    most = max(LEAST_CELL, -(-n // max(len(points), 1)))
    cuts = F.percentile_approx("_r", [i / MOST_RINGS for i in range(1, MOST_RINGS)], 20 * MOST_RINGS)
    edges, base, cut = [()] * len(points), np.zeros(len(points), np.int64), np.ones(len(points), np.int64)
    total = 0
    for r in sorted(homes.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), cuts.alias("c")).collect(), key=lambda r: r["_p"]):
        rings = min(MOST_RINGS, -(-r["n"] // most))
        edges[r["_p"]] = tuple(sorted({r["c"][i * MOST_RINGS // rings - 1] for i in range(1, rings)}))
        cut[r["_p"]] = max(1, -(-r["n"] // (most * MOST_RINGS)))
        base[r["_p"]] = total
        total += (len(edges[r["_p"]]) + 1) * int(cut[r["_p"]])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, r = batch.column("_p").to_numpy(), batch.column("_r").to_numpy()
            h = batch.column("_h").to_numpy()
            ring = np.array([np.searchsorted(edges[a], b) for a, b in zip(p.tolist(), r.tolist())], np.int64) if len(p) else p.astype(np.int64)
            cell = base[p] + ring * cut[p] + h % cut[p]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cell)], names=[*batch.schema.names[:-1], "_cell"])

    hashed = homes.withColumn("_h", F.pmod(F.xxhash64("_k"), F.lit(1 << 30)))
    held = written(hashed.mapInArrow(placed, _with(homes, "_cell long")), "cells")
    stats = {r["_cell"]: r for r in held.groupBy("_cell").agg(F.min("_p").alias("p"), F.count(F.lit(1)).alias("n"), F.min("_r").alias("lo"), F.max("_r").alias("hi")).collect()}
    column = lambda name, empty: np.array([stats[c][name] if c in stats else empty for c in range(total)])
    own: dict[object, np.ndarray] = {}
    if parts:
        counts = held.groupBy("_part", "_cell").agg(F.count(F.lit(1)).alias("n"))
        kinds = held.select("_part").distinct().count()
        if kinds * total <= MOST_OWN:
            for r in counts.toLocalIterator():
                own.setdefault(r["_part"], np.zeros(total, np.int64))[r["_cell"]] = r["n"]
    return held, Cells(points, column("p", 0).astype(np.int64), column("n", 0).astype(np.int64), column("lo", np.inf).astype(float), column("hi", -np.inf).astype(float), own)


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), more])


def asked_cells(queries: DataFrame, cells: Cells, k: int, width: int, bounded: bool, root: bool = False) -> DataFrame:
    """Adds ``_cell``, one row per cell to meet: the first ones or, given the k-th distance ``_far`` (NULL: none yet), all others that may hold nearer rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = _distances(cells.pivots, cells.pivots)
        for batch in batches:
            w, names = _vectors(batch.column("_w"), width), batch.schema.names
            parts = batch.column("_own").to_pylist() if "_own" in names else [None] * len(w)
            far = batch.column("_far").to_numpy(zero_copy_only=False) if bounded else None
            for s in _blocks(len(w), len(cells.n)):
                lower, upper, left = cells.around(w[s], parts[s], between)
                mask = cells.first(upper, left, k)
                if bounded:
                    bound = np.where(np.isnan(far[s].astype(float)), np.inf, far[s].astype(float))
                    mask = ~mask & (left > 0) & (lower <= (bound if root else np.sqrt(bound))[:, None])
                q, c = np.nonzero(mask)
                own = batch.slice(s.start, s.stop - s.start).take(pa.array(q))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(c.astype(np.int64))], names=[*names, "_cell"])

    return queries.mapInArrow(run, _with(queries, "_cell long"))


def _meet(asked: DataFrame, held: DataFrame, cells: Cells, k: int, width: int, parts: bool, root: bool) -> DataFrame:
    """(``_q``, ``_d`` (squared without ``root``), ``_k``, ``_y``): the k best rows of each query in each cell it meets, none farther than ``_far``."""
    spark, bounded = asked.sparkSession, "_far" in asked.columns
    busy = [{"_cell": r["_cell"], "_deals": -(-r["n"] // QUERY_ROWS)} for r in asked.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()]  # a row per cell
    deals = F.broadcast(spark.createDataFrame(pa.Table.from_pylist(busy, pa.schema([("_cell", pa.int64()), ("_deals", pa.int64())]))))  # a row per cell
    asked = asked.join(deals, "_cell").withColumn("_deal", F.pmod(F.xxhash64("_q"), F.col("_deals"))).drop("_deals")
    held = held.join(deals, "_cell").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1))).drop("_deals")

    def nearest(queries: pa.Table, rows: pa.Table) -> pa.Table:
        at, best = [np.zeros(0, np.int64)], [np.zeros((0, 1))]
        picks = [np.zeros(0, np.int64)]
        if queries.num_rows and rows.num_rows:
            rows = rows.sort_by("_k")
            v, w = _vectors(rows.column("_v"), width), _vectors(queries.column("_w"), width)
            if parts:
                kinds = pa.chunked_array([*rows.column("_part").chunks, *queries.column("_own").chunks]).combine_chunks().dictionary_encode()
                code = (kinds.combine_chunks() if isinstance(kinds, pa.ChunkedArray) else kinds).indices.to_numpy()
                mine, theirs = code[rows.num_rows :], code[: rows.num_rows]
            far = queries.column("_far").to_numpy().astype(float) if bounded else None  # NULL is NaN
            for s in _blocks(len(w), len(v)):
                dist = np.zeros((s.stop - s.start, len(v)))
                for f in range(width):
                    dist += (w[s, f, None] - v[None, :, f]) ** 2
                if root:
                    dist = np.sqrt(dist)
                if parts:
                    dist[mine[s, None] == theirs[None, :]] = np.inf
                if bounded:
                    dist[dist > far[s, None]] = np.inf
                top = min(k, len(v))
                edge = np.partition(dist, top - 1, axis=1)[:, top - 1]
                q, r = np.nonzero((dist <= edge[:, None]) & np.isfinite(dist))
                # rows are in the order of their keys: of equal distances the first stay
                order = np.lexsort((r, dist[q, r], q))
                q, r = q[order], r[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                q, r = q[keep], r[keep]
                at.append(q + s.start)
                best.append(dist[q, r][:, None])
                picks.append(r)
        at, best, picks = np.concatenate(at), np.concatenate(best)[:, 0], pa.array(np.concatenate(picks))
        take = lambda t, c: t.column(c).combine_chunks().take(picks if t is rows else pa.array(at))
        return pa.table({"_q": take(queries, "_q"), "_d": pa.array(best), "_k": take(rows, "_k"), "_y": take(rows, "_y")})

    schema = f"_q {dict(asked.dtypes)['_q']}, _d double, _k {dict(held.dtypes)['_k']}, _y double"
    asked, held = (df.repartition(_tasks(spark), "_cell", "_deal") for df in (asked, held))
    return asked.groupBy("_cell", "_deal").cogroup(held.groupBy("_cell", "_deal")).applyInArrow(nearest, schema)


def _tasks(spark: SparkSession) -> int:
    """Rows here are few bytes and much work: left to the sizes of shuffles, one task would often get all of them."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def nearest_rows(test: DataFrame, train: DataFrame, features: list[str], y: str, key: str, k: int = 8, apart: str | None = None, pivots: int | None = None) -> DataFrame:
    """(test_key, train_key, value, dist2, rn): the k training rows nearest to each test row by squared distance of the features; ties by key.

    With ``apart`` (such as fold) rows whose value of it equals the test row's do not count, so rows of all folds find their neighbours in one
    search. Rows with a NULL feature (training rows also: a NULL y; with ``apart``: a NULL part) take no part. Of training rows at one place only the
    first k can matter, so piles of equal points do not multiply. Keys of test rows are unique. Fewer than k training rows give fewer neighbours.
    """
    vector = F.array(*(F.col(f).cast("double") for f in features))
    rows = train.dropna(subset=[*features, y, *([apart] if apart else [])])
    rows = rows.select(F.col(key).alias("_k"), F.col(y).cast("double").alias("_y"), vector.alias("_v"), *([F.col(apart).alias("_part")] if apart else []))
    queries = test.dropna(subset=[*features, *([apart] if apart else [])])
    queries = queries.select(F.col(key).alias("_q"), vector.alias("_w"), *([F.col(apart).alias("_own")] if apart else []))
    return _named(search(queries, rows, len(features), k, pivots))


def search(queries: DataFrame, rows: DataFrame, width: int, k: int, pivots: int | None = None, root: bool = False) -> DataFrame:
    """(``_q``, ``_d``, ``_k``, ``_y``, ``_n``): of queries (``_q``, ``_w``, perhaps ``_own``) the k nearest rows (``_k``, ``_y``, ``_v``, perhaps ``_part``).

    ``_d`` is the squared distance or, with ``root``, the distance, by which ties are then told. ``_y`` may be NULL.
    """
    apart = "_part" in rows.columns
    tasks = _tasks(queries.sparkSession)
    rows = written(first_of_each_place(rows, k, "_v", *(["_part"] if apart else [])).repartition(tasks, "_k"), "rows")
    held, cells = build(rows, width, apart, pivots)
    rank = Window.partitionBy("_q").orderBy("_d", "_k")
    top = lambda df: df.withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= k)
    if len(cells.n) == 1:
        return top(_meet(queries.withColumn("_cell", F.lit(0).cast("long")), held, cells, k, width, apart, root))
    queries = written(queries.repartition(tasks, "_q"), "queries")
    asked = written(asked_cells(queries, cells, k, width, False), "asked")
    one = written(top(_meet(asked, held, cells, k, width, apart, root)), "near")
    # a k-th distance that is not reached yet rules nothing out
    far = one.filter(F.col("_n") == k).select(F.col("_q").alias("_q1"), F.col("_d").alias("_far"))
    bounded = queries.join(far, F.col("_q") == F.col("_q1"), "left").drop("_q1")
    two = _meet(written(asked_cells(bounded, cells, k, width, True, root), "asked"), held, cells, k, width, apart, root)
    return top(one.drop("_n").unionByName(two))


def _named(near: DataFrame) -> DataFrame:
    return near.select(F.col("_q").alias("test_key"), F.col("_k").alias("train_key"), F.col("_y").alias("value"), F.col("_d").alias("dist2"), F.col("_n").alias("rn"))
