"""Nearest neighbours and radius counts on the sphere, exact, by joins on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geo import arc_km, chord, unit_sphere
from plumbline.operators.metric_index import search
from plumbline.operators.ranking import quantiles
from plumbline.shared import written

#: Grid levels: cells of edge 2**-level in the cube around the sphere. Level -2 is one neighbourhood.
FINEST, COARSEST = 12, -2
#: Up to so many training rows and pairs, all pairs are compared; beyond either, the grid is used.
SMALL_TRAIN, SMALL_PAIRS = 50_000, 5_000_000
_XYZ = ("_x", "_y", "_z")


def _placed(df: DataFrame, lon: str, lat: str) -> DataFrame:
    x, y, z = unit_sphere(F.col(lon), F.col(lat))
    return df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumns({"_x": x, "_y": y, "_z": z})


def _cell(level: Column, *shift: Column) -> Column:
    edge = F.pow(F.lit(2.0), level)
    parts = [F.floor((F.col(c) + 1) * edge).cast("long") + (s if shift else 0) for c, s in zip(_XYZ, shift or (0, 0, 0))]
    return F.xxhash64(level.cast("int"), *parts)


def _around(level: Column) -> Column:
    """The 27 cells around a point."""
    step = F.array(*(F.lit(i).cast("long") for i in (-1, 0, 1)))
    return F.flatten(F.transform(step, lambda a: F.flatten(F.transform(step, lambda b: F.transform(step, lambda c: _cell(level, a, b, c))))))


def knn_join(test: DataFrame, train: DataFrame, k: int, key: str, value: str, lon: str = "lon", lat: str = "lat", keys: tuple[str, ...] = (), apart: str | None = None, small: bool = True) -> DataFrame:
    """(keys, test_key, train_key, value, dist, rn): the k nearest training rows of each test row by chord; ties by key.

    ``keys`` must agree on both sides; of ``apart`` (such as fold) both must have different values that are not NULL, so that rows of all
    folds find their neighbours outside their own in one search. Small inputs, by a count of both sides, are compared in full unless ``small`` is false.
    Without ``keys`` the search runs on cells around pivots (``metric_index``): a row in the middle of a wide block, far from all that it may meet,
    skips the cells of its own block. With ``keys`` each test row first meets the training rows in the finest grid
    neighbourhood that holds at least k of them. If its k-th distance is within a cell's edge the result is final;
    otherwise a second round uses the finest grid whose cells are as wide as that distance, which is enough. Of training rows at one
    place only the first k by key can matter, so places that hold many rows do not multiply. Fewer than k
    training rows give fewer neighbours.
    """
    keys = list(keys)
    if apart:
        test, train = test.filter(F.col(apart).isNotNull()), train.filter(F.col(apart).isNotNull())
    own_part, part = (["_own"], ["_part"]) if apart else ([], [])
    mine = lambda names: [F.col(apart).alias(c) for c in names]
    every = _placed(train, lon, lat).select(*keys, *mine(part), F.col(key).alias("train_key"), F.col(value).cast("double").alias("value"), *_XYZ)
    n_train = every.count() if small else 0
    spot = Window.partitionBy(*keys, *part, *_XYZ).orderBy("train_key")
    tr = every.withColumn("_r", F.row_number().over(spot)).filter(F.col("_r") <= k).drop("_r")
    te = _placed(test, lon, lat).select(*keys, *mine(own_part), F.col(key).alias("test_key"), *_XYZ)
    other = F.col("_own") != F.col("_part") if apart else F.lit(True)
    cols = [*keys, "test_key", "train_key", "value", "dist", "rn"]
    d = chord(tuple(F.col(c) for c in _XYZ), tuple(F.col(f"t{c}") for c in _XYZ))
    near = Window.partitionBy(*keys, "test_key").orderBy("dist", "train_key")
    if small and n_train <= SMALL_TRAIN and n_train * te.count() <= SMALL_PAIRS:
        there = F.broadcast(tr.withColumnsRenamed({c: f"t{c}" for c in _XYZ}))  # at most SMALL_TRAIN rows
        pairs = te.join(there, keys) if keys else te.join(there)
        return pairs.filter(other).withColumn("dist", d).withColumn("rn", F.row_number().over(near)).filter(F.col("rn") <= k).select(*cols)
    if not keys:
        rows = every.select(F.col("train_key").alias("_k"), F.col("value").alias("_y"), F.array(*_XYZ).alias("_v"), *part)
        near = search(te.select(F.col("test_key").alias("_q"), F.array(*_XYZ).alias("_w"), *own_part), rows, len(_XYZ), k, root=True)
        return near.select(F.col("_q").alias("test_key"), F.col("_k").alias("train_key"), F.col("_y").alias("value"), F.col("_d").alias("dist"), F.col("_n").alias("rn"))
    levels = F.array(*(F.lit(v) for v in range(COARSEST, FINEST + 1)))
    # how many training rows each cell of each level holds
    cell_keys = [*keys, "level", "cell"]
    counts = tr.select(*keys, *part, *_XYZ, F.explode(levels).alias("level")).groupBy(*keys, *part, "level", _cell(F.col("level")).alias("cell")).agg(F.count(F.lit(1)).alias("_c"))
    per_part = counts.withColumnsRenamed({"_part": "_own", "_c": "_o"})
    counts = counts.groupBy(*cell_keys).agg(F.sum("_c").alias("_c")) if apart else counts

    def counted(at: DataFrame) -> DataFrame:
        """Training rows of each cell, less those that must not be met."""
        out = at.join(counts, cell_keys, "left")
        return out.join(per_part, [*cell_keys, "_own"], "left").withColumn("_c", F.col("_c") - F.coalesce("_o", F.lit(0))).drop("_o") if apart else out

    # the finest level whose own cell holds k is near the one wanted: only two finer ones need their neighbours counted
    who = [*keys, *own_part, "test_key", *_XYZ]
    spots = te.select(*who, F.explode(levels).alias("level")).withColumn("cell", _cell(F.col("level")))
    own = counted(spots).groupBy(*who).agg(F.coalesce(F.max(F.when(F.col("_c") >= k, F.col("level"))), F.lit(COARSEST)).alias("_l"))
    finer = F.sequence("_l", F.least(F.col("_l") + 2, F.lit(FINEST)))
    asked = own.select(*who, F.explode(finer).alias("level")).withColumn("cell", F.explode(_around(F.col("level"))))
    held = counted(asked).groupBy(*who, "level").agg(F.sum("_c").alias("_c"))
    first = held.groupBy(*who).agg(F.coalesce(F.max(F.when(F.col("_c") >= k, F.col("level"))), F.lit(COARSEST)).alias("level"))

    def meet(at: DataFrame) -> DataFrame:
        used = at.select("level").distinct()
        cells = tr.join(used).withColumn("cell", _cell(F.col("level"))).withColumnsRenamed({c: f"t{c}" for c in _XYZ})  # a row per used level, 15 at most
        pairs = at.withColumn("cell", F.explode(_around(F.col("level")))).join(cells, [*keys, "level", "cell"])
        pairs = pairs.filter(other).withColumn("dist", d).withColumn("rn", F.row_number().over(near)).filter(F.col("rn") <= k)
        return pairs.select(*who, "level", "train_key", "value", "dist", "rn")

    one = written(meet(first), "knn")  # read three times below
    far = one.groupBy(*who, "level").agg(F.max("dist").alias("_d"))
    far = far.filter((F.col("_d") > F.pow(F.lit(2.0), -F.col("level"))) & (F.col("level") > COARSEST))
    again = far.select(*who, F.greatest(F.lit(COARSEST), F.least(F.col("level") - 1, F.floor(-F.log2("_d")))).cast("int").alias("level"))
    final = one.join(again.select(*keys, "test_key"), [*keys, "test_key"], "left_anti").select(*cols)
    return final.unionByName(meet(again).select(*cols))


def idw(neighbours: DataFrame, keys: tuple[str, ...] = (), ks: tuple[int, ...] = (8,), floor: float = 1e-6, scale: float = 1.0) -> DataFrame:
    """(keys, test_key, k, pred): means of the first k neighbours weighted by 1 / max(dist * scale, floor)."""
    w = 1 / F.greatest(F.col("dist") * F.lit(scale), F.lit(floor))
    rows = neighbours.filter(F.col("value").isNotNull()).select("*", F.explode(F.array(*map(F.lit, ks))).alias("k")).filter(F.col("rn") <= F.col("k"))
    return rows.groupBy(*keys, "test_key", "k").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("pred"))


def nearest_and_density(test: DataFrame, train: DataFrame, radius_km: float, key: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(test_key, nearest_km, n_within): distance to the nearest training row and training rows within a radius.

    The radius count joins on cells as wide as the radius; training rows at one place are counted together.
    """
    import math

    limit = 2 * math.sin(min(radius_km / (2 * 6371.0), math.pi / 2))
    level = F.lit(max(COARSEST, min(20, math.floor(-math.log2(limit)))))
    spots = _placed(train, lon, lat).groupBy(*_XYZ).agg(F.count(F.lit(1)).alias("_c")).withColumn("cell", _cell(level)).withColumnsRenamed({c: f"t{c}" for c in _XYZ})
    te = _placed(test, lon, lat).select(F.col(key).alias("test_key"), *_XYZ)
    pairs = te.withColumn("cell", F.explode(_around(level))).join(spots, "cell")
    d = chord(tuple(F.col(c) for c in _XYZ), tuple(F.col(f"t{c}") for c in _XYZ))
    within = pairs.groupBy("test_key").agg(F.sum(F.when(d <= limit, F.col("_c")).otherwise(0)).alias("n_within"))
    nearest = knn_join(test, train.withColumn("_v", F.lit(0.0)), 1, key, "_v", lon, lat).select("test_key", arc_km(F.col("dist")).alias("nearest_km"))
    return te.select("test_key").join(nearest, "test_key", "left").join(within, "test_key", "left").select("test_key", "nearest_km", F.coalesce("n_within", F.lit(0)).cast("long").alias("n_within"))


def quantile_bins(df: DataFrame, x: str, steps: int = 5) -> DataFrame:
    """Adds bin: the equal-frequency bin of x between its distinct quantiles; the last bin is closed. NULL x has none."""
    edges = quantiles(df, [], x, [i / steps for i in range(steps + 1)]).select(F.array_distinct("q").alias("_e"))
    at = F.size(F.filter("_e", lambda e: e <= F.col(x)))
    return df.join(F.broadcast(edges), how="left").withColumn("bin", F.when(F.col(x).isNotNull(), F.least(at, F.greatest(F.size("_e") - 1, F.lit(1))))).drop("_e")  # one row
