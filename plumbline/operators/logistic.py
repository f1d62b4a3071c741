"""Logistic regression for all folds at once: Newton steps on sums.

A fold's model learns from the rows outside the fold. A step needs the gradient and the second derivatives of every model: one aggregate over
(row, model) pairs keyed by model, whose partial sums leave each task as one row a model. A driver solves systems of (features + 1)
unknowns, one a model. The number of steps is fixed, so the same sums can be written in SQL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Keeps a step defined where classes are separable or a feature is constant; part of the penalty.
FLOOR = 1e-9
#: More models than this do not go out with a task: split the folds among several calls.
MOST_MODELS = 20_000


def _models(df: DataFrame, keys: list[str], fold: str, features: list[str], w: Column) -> list:
    """Per model the training rows' weight, means and population deviations, from totals less the fold's own."""
    x = [F.col(f).cast("double") for f in features]
    sums = [F.sum(w).alias("n"), *(F.sum(w * c).alias(f"s{i}") for i, c in enumerate(x)), *(F.sum(w * c * c).alias(f"q{i}") for i, c in enumerate(x))]
    rows = df.groupBy(*keys, fold).agg(*sums).limit(MOST_MODELS + 1).collect()
    if len(rows) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    p, total = len(features), {}
    part = {}
    for r in rows:
        own = np.array([r["n"], *(r[f"s{i}"] for i in range(p)), *(r[f"q{i}"] for i in range(p))], float)
        part[(*(r[k] for k in keys), r[fold])] = own
        total[tuple(r[k] for k in keys)] = total.get(tuple(r[k] for k in keys), 0) + own
    out = []
    for at, own in part.items():
        rest = total[at[:-1]] - own
        if rest[0] > 1e-12:
            mean = rest[1 : p + 1] / rest[0]
            out.append((at, mean, np.sqrt(np.maximum(rest[p + 1 :] / rest[0] - mean * mean, 0)) + 1e-8))
    return out


def cross_fit_logistic(
    df: DataFrame, fold: str, features: list[str], label: str, alpha: float = 0.0, steps: int = 8, keys: tuple[str, ...] = (), weight: str | None = None, name: str = "pred"
) -> DataFrame:
    """Adds the probability that the label is 1, from the model of the rows with the same ``keys`` and another fold.

    Features are centred and scaled by the training rows' mean and population deviation + 1e-8. The loss is the (weighted) mean log loss and alpha / 2 times
    the squared coefficients, the intercept's excepted; ``steps`` Newton steps from zero. Rows with a NULL feature have no prediction; they, rows
    with a NULL label and rows with a NULL fold are not learnt from. A fold with no rows outside it has NULL predictions.
    """
    keys_, spark = list(keys), df.sparkSession
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    own = df.dropna(subset=[*features, label, fold, *keys_, *([weight] if weight else [])])
    models = _models(own, keys_, fold, features, w)
    columns = own.select(*keys_, F.col(fold).alias("_f"), *(F.array(F.lit(0.0)).alias(c) for c in ("_m", "_s", "_b"))).schema
    theta = {at: np.zeros(len(features) + 1) for at, *_ in models}

    def coefficients() -> DataFrame:
        rows = [dict(zip(columns.names, (*at, m.tolist(), s.tolist(), theta[at].tolist()))) for at, m, s in models]
        table = pa.Table.from_pylist(rows, to_arrow_schema(columns))  # as Arrow: else Python workers start only to copy a few rows
        return F.broadcast(spark.createDataFrame(table, columns))  # at most MOST_MODELS rows

    def scaled(i: int) -> Column:
        return (F.col(features[i]).cast("double") - F.col("_m")[i]) / F.col("_s")[i]

    def probability() -> Column:
        return 1 / (1 + F.exp(-sum((F.col("_b")[i + 1] * scaled(i) for i in range(len(features))), F.col("_b")[0])))

    p = len(features) + 1
    z = [F.lit(1.0), *(F.col(f"_z{i}") for i in range(len(features)))]
    for _ in range(steps if models else 0):
        pairs = own.join(coefficients(), keys_) if keys_ else own.crossJoin(coefficients())  # each row meets the models it teaches
        pairs = pairs.filter(F.col(fold) != F.col("_f"))
        pairs = pairs.select(*keys_, "_f", w.alias("_w"), F.col(label).cast("double").alias("_y"), probability().alias("_p"), *(scaled(i).alias(f"_z{i}") for i in range(len(features))))
        miss, curve = F.col("_w") * (F.col("_y") - F.col("_p")), F.col("_w") * F.col("_p") * (1 - F.col("_p"))
        sums = [F.sum("_w").alias("n"), *(F.sum(miss * z[i]).alias(f"g{i}") for i in range(p))]
        sums += [F.sum(curve * z[i] * z[j]).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)]
        for r in pairs.groupBy(*keys_, "_f").agg(*sums).collect():
            at = (*(r[k] for k in keys_), r["_f"])
            shrink = np.array([0.0, *[alpha] * (p - 1)])
            g = np.array([r[f"g{i}"] for i in range(p)]) / r["n"] - shrink * theta[at]
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) / r["n"] + np.diag(shrink + FLOOR)
            theta[at] = theta[at] + np.linalg.solve(h, g)
    both = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys_]
    joined = df.alias("d").join(coefficients().alias("c"), [*both, F.col(f"d.{fold}") == F.col("c._f")], "left")
    return joined.select("d.*", F.when(F.col("c._f").isNotNull(), _of_row(features)).alias(name))


def _of_row(features: list[str]) -> Column:
    dot = sum((F.col("c._b")[i + 1] * ((F.col(f"d.{f}").cast("double") - F.col("c._m")[i]) / F.col("c._s")[i]) for i, f in enumerate(features)), F.col("c._b")[0])
    return 1 / (1 + F.exp(-dot))
