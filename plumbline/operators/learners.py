"""Learners. Linear ones come from one pass of sums; trees and the rest are Spark ML's.

Additive statistics of a training set that is everything outside a fold are the
totals less the fold's, so linear models for all folds cost one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.metric_index import nearest_rows
from plumbline.operators.ranking import quantiles


def gram(df: DataFrame, keys: list[str], features: list[str], y: str, weight: Column | None = None) -> DataFrame:
    """(keys, n, and the sums of products of 1, the features and y); rows with a missing value are left out."""
    cols = [*features, y]
    w = F.lit(1.0) if weight is None else weight
    rows = df.dropna(subset=cols)
    aggs = [F.sum(w).alias("n")]
    for i, a in enumerate(cols):
        aggs.append(F.sum(w * F.col(a)).alias(f"s_{i}"))
        aggs += [F.sum(w * F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for j, b in enumerate(cols) if j >= i]
    return rows.groupBy(*keys).agg(*aggs)


def _moments(row, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    n = float(row["n"] or 0)
    s = np.array([row[f"s_{i}"] or 0.0 for i in range(p + 1)], float)
    q = np.zeros((p + 1, p + 1))
    for i in range(p + 1):
        for j in range(i, p + 1):
            q[i, j] = q[j, i] = row[f"p_{i}_{j}"] or 0.0
    return n, s, q


def solve_ridge(n: float, s: np.ndarray, q: np.ndarray, alpha: float, standardise: bool = True) -> tuple[np.ndarray, float]:
    """(coefficients on the raw features, intercept). Features are centred, and scaled by population sd + 1e-8."""
    p = len(s) - 1
    mean = s / n
    cov = q / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:p], 0)) + 1e-8 if standardise else np.ones(p)
    a = cov[:p, :p] / np.outer(scale, scale) * n + alpha * np.eye(p)
    b = cov[:p, p] / scale * n
    beta = (np.linalg.solve(a, b) if alpha > 0 else np.linalg.lstsq(a, b, rcond=None)[0]) / scale
    return beta, float(mean[p] - beta @ mean[:p])


def solve_elastic(n: float, s: np.ndarray, q: np.ndarray, alpha: float, l1_ratio: float, sweeps: int = 2000, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """Lasso and elastic net, (1/2n) SSE + alpha (r |b| + (1 - r) / 2 b^2), by coordinate descent on the moments."""
    p = len(s) - 1
    mean = s / n
    cov = q / n - np.outer(mean, mean)
    beta = np.zeros(p)
    for _ in range(sweeps):
        move = 0.0
        for j in range(p):
            rho = cov[j, p] - cov[j, :p] @ beta + cov[j, j] * beta[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0) / (cov[j, j] + alpha * (1 - l1_ratio)) if cov[j, j] > 0 else 0.0
            move, beta[j] = max(move, abs(new - beta[j])), new
        if move < tol:
            break
    return beta, float(mean[p] - beta @ mean[:p])


def fit_linear(df: DataFrame, features: list[str], y: str, alpha: float = 0.0, l1_ratio: float | None = None, standardise: bool = True) -> tuple[np.ndarray, float]:
    """One model from one aggregate over the table."""
    n, s, q = _moments(gram(df, [], features, y).first(), len(features))
    return solve_elastic(n, s, q, alpha, l1_ratio) if l1_ratio is not None else solve_ridge(n, s, q, alpha, standardise)


def linear_column(features: list[str], beta: np.ndarray, intercept: float) -> Column:
    return sum((F.lit(float(b)) * F.col(f) for f, b in zip(features, beta)), F.lit(float(intercept)))


def cross_fit_linear(df: DataFrame, fold: str, features: list[str], y: str, alpha: float = 1.0, standardise: bool = True, name: str = "pred") -> DataFrame:
    """Adds the prediction for each row of a model fitted on all rows outside its fold.

    The folds' sums (one row a fold) reach the driver; each fold's model is solved from the totals less its own. The models go out
    to the rows: a join by fold alone would send all rows of a fold to one task.
    """
    rows = gram(df, [fold], features, y).collect()
    parts = {r[fold]: _moments(r, len(features)) for r in rows}
    total = [sum(p[i] for p in parts.values()) for i in range(3)] if parts else None
    models = [(f, *solve_ridge(total[0] - p[0], total[1] - p[1], total[2] - p[2], alpha, standardise)) for f, p in parts.items() if total[0] > p[0]]
    schema = f"{fold} {dict(df.dtypes)[fold]}, _b array<double>, _a double"
    coef = df.sparkSession.createDataFrame([(f, [float(v) for v in b], a) for f, b, a in models], schema)
    dot = sum((F.col("_b")[i] * F.col(f) for i, f in enumerate(features)), F.col("_a"))
    return df.join(F.broadcast(coef), fold, "left").withColumn(name, dot).drop("_b", "_a")


def fit_lda(df: DataFrame, features: list[str], label: str) -> tuple[list, np.ndarray, np.ndarray]:
    """(classes, weights, biases) of a linear discriminant: class means, pooled covariance, priors."""
    rows = sorted(gram(df.withColumn("_zero", F.lit(0.0)), [label], features, "_zero").collect(), key=lambda r: r[label])
    p, mom = len(features), []
    for r in rows:
        n, s, q = _moments(r, p)
        mom.append((r[label], n, s[:p] / n, q[:p, :p] - np.outer(s[:p], s[:p]) / n))
    total = sum(m[1] for m in mom)
    pooled = sum(m[3] for m in mom) / max(total - len(mom), 1)
    w = np.linalg.pinv(pooled) @ np.stack([m[2] for m in mom], 1)
    bias = np.array([-0.5 * m[2] @ w[:, i] + np.log(m[1] / total) for i, m in enumerate(mom)])
    return [m[0] for m in mom], w, bias


def lda_scores(df: DataFrame, features: list[str], model: tuple[list, np.ndarray, np.ndarray]) -> DataFrame:
    """Adds score_0.. (one per class, in order) and pred (the class with the largest)."""
    classes, w, b = model
    out = df.select("*", *(linear_column(features, w[:, i], b[i]).alias(f"score_{i}") for i in range(len(classes))))
    best = F.greatest(*(F.col(f"score_{i}") for i in range(len(classes)))) if len(classes) > 1 else F.col("score_0")
    pred = F.coalesce(*(F.when(F.col(f"score_{i}") == best, F.lit(c)) for i, c in enumerate(classes)))
    return out.withColumn("pred", pred)


def median_impute(df: DataFrame, fold: str, features: list[str], train: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """NULL features become the training median (exact; 0 if a feature is missing throughout). Fitted on ``train(df)``."""
    own, med = (train(df) if train else df), df.sparkSession.range(1).select()
    for f in features:
        one = quantiles(own, [], f, [0.5]).agg(F.coalesce(F.max(F.get("q", F.lit(0))), F.lit(0.0)).alias(f"_m_{f}"))
        med = med.join(one)  # one row each
    return df.join(F.broadcast(med)).withColumns({f: F.coalesce(F.col(f), F.col(f"_m_{f}")) for f in features}).drop(*(f"_m_{f}" for f in features))  # one row


def standardise(df: DataFrame, features: list[str], is_train: Column | None = None) -> DataFrame:
    """Features less the training mean, over the population sd + 1e-8."""
    pick = (lambda f: F.when(is_train, F.col(f))) if is_train is not None else F.col
    stats = df.agg(*(F.avg(pick(f)).alias(f"_a_{f}") for f in features), *(F.stddev_pop(pick(f)).alias(f"_s_{f}") for f in features))
    out = df.join(F.broadcast(stats)).withColumns({f: (F.col(f) - F.col(f"_a_{f}")) / (F.col(f"_s_{f}") + 1e-8) for f in features})  # one row
    return out.drop(*(f"_{t}_{f}" for t in "as" for f in features))


def balance_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Adds negatives / positives for positives and 1 for negatives."""
    c = df.agg(F.sum((F.col(label) > 0.5).cast("double")).alias("_p"), F.sum((F.col(label) <= 0.5).cast("double")).alias("_n"))
    return df.join(F.broadcast(c)).withColumn(name, F.when(F.col(label) > 0.5, F.coalesce(F.try_divide("_n", "_p"), F.lit(1.0))).otherwise(1.0)).drop("_p", "_n")  # one row


def polynomial(features: list[str]) -> dict[str, Column]:
    """Degree-2 terms: the features, their squares and products."""
    out = {f: F.col(f) for f in features}
    for i, a in enumerate(features):
        for b in features[i:]:
            out[f"{a}*{b}"] = F.col(a) * F.col(b)
    return out


def forest(trees: int = 200, depth: int = 6, seed: int = 42):
    from pyspark.ml.regression import RandomForestRegressor

    return RandomForestRegressor(numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed)


def forest_classifier(trees: int = 150, depth: int = 6, seed: int = 42):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)


def boosting(rounds: int = 60, depth: int = 5, rate: float = 0.05, seed: int = 42):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)


def boosting_classifier(rounds: int = 60, depth: int = 5, rate: float = 0.05, seed: int = 42):
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)


def logistic(alpha: float = 0.0, weight: str | None = None):
    from pyspark.ml.classification import LogisticRegression

    m = LogisticRegression(regParam=alpha, maxIter=100)
    return m.setWeightCol(weight) if weight else m


def perceptron(layers: list[int], seed: int = 42):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(layers=layers, maxIter=60, seed=seed)


def linear(alpha: float = 0.0, l1_ratio: float | None = None) -> Callable:
    """A linear learner for ``predicted``: its solution from one pass of sums."""

    def run(train: DataFrame, test: DataFrame, features: list[str], y: str, key: str, name: str) -> DataFrame:
        beta, a = fit_linear(train, features, y, alpha, l1_ratio)
        return test.withColumn(name, linear_column(features, beta, a))

    return run


def discriminant() -> Callable:
    def run(train: DataFrame, test: DataFrame, features: list[str], y: str, key: str, name: str) -> DataFrame:
        scored = lda_scores(test, features, fit_lda(train, features, y))
        return scored.select(*test.columns, F.col("pred").alias(name))

    return run


def neighbours(k: int = 8) -> Callable:
    def run(train: DataFrame, test: DataFrame, features: list[str], y: str, key: str, name: str) -> DataFrame:
        near = knn_features(test, train, features, y, key, k).select(F.col("test_key").alias("_tk"), F.col("pred").alias(name))
        return test.join(near, test[key] == F.col("_tk"), "left").drop("_tk")

    return run


#: Learners by name, for ``predicted``: functions of (train, test, features, y, key, name), or Spark ML estimators.
REGISTRY: dict[str, Callable] = {
    "ols": linear, "ridge": lambda: linear(1.0), "lasso": lambda: linear(0.001, 1.0), "elastic_net": lambda: linear(0.001, 0.5), "discriminant": discriminant, "knn": neighbours,
    "forest": forest, "forest_classifier": forest_classifier, "boosting": boosting, "boosting_classifier": boosting_classifier, "logistic": logistic,
    "perceptron": lambda: perceptron([4, 8, 2]),
}


def predicted(model: str, train: DataFrame, test: DataFrame, features: list[str], y: str, key: str, name: str = "pred") -> DataFrame:
    """Test rows with the prediction of the learner of that name, fitted on the training rows."""
    made = REGISTRY[model]()
    return made(train, test, features, y, key, name) if callable(made) and not hasattr(made, "fit") else fit_predict(made, train, test, features, y, name)


def fit_predict(estimator, train: DataFrame, test: DataFrame, features: list[str], y: str, name: str = "pred") -> DataFrame:
    """Test rows with the estimator's prediction (the positive class's probability if it has one). No NULL features."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    put = VectorAssembler(inputCols=features, outputCol="_x")
    as_label = F.col(y).cast("double").alias("_label")
    model = estimator.setFeaturesCol("_x").setLabelCol("_label").fit(put.transform(train).select("_x", as_label, *([estimator.getWeightCol()] if estimator.hasParam("weightCol") and estimator.isSet("weightCol") else [])))
    out = model.transform(put.transform(test))
    pred = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select(*test.columns, pred.alias(name))


def fit_or_status(make: Callable[[], DataFrame], spark, schema: str, **labels: str) -> DataFrame:
    """The result with status ``ok``, or one row with status ``failed`` and the reason, NULL elsewhere: a failed fit does not stop a panel."""
    try:
        return make().withColumns({"status": F.lit("ok"), "reason": F.lit(None).cast("string"), **{k: F.lit(v) for k, v in labels.items()}})
    except Exception as e:  # noqa: BLE001 - the reason is the result
        empty = spark.createDataFrame([tuple([None] * len(schema.split(",")))], schema)
        return empty.withColumns({"status": F.lit("failed"), "reason": F.lit(type(e).__name__), **{k: F.lit(v) for k, v in labels.items()}})


def knn_features(test: DataFrame, train: DataFrame, features: list[str], y: str, key: str, k: int = 8, apart: str | None = None) -> DataFrame:
    """(test_key, pred): the mean of y over the k training rows nearest in feature space; ties by key. ``apart``: see ``nearest_rows``."""
    return nearest_rows(test, train, features, y, key, k, apart).groupBy("test_key").agg(F.avg("value").alias("pred"))


def cross_fit_single(df: DataFrame, fold: str, features: list[str], y: str, name: str = "pred") -> DataFrame:
    """Adds the prediction of the one-variable line that fits the rows outside a row's fold best; ties go to the later feature.

    As in ``cross_fit_linear`` one row of sums a fold reaches the driver.
    """
    rows = gram(df, [fold], features, y).collect()
    parts = {r[fold]: _moments(r, len(features)) for r in rows}
    total = [sum(p[i] for p in parts.values()) for i in range(3)] if parts else None
    lines = []
    for f, part in parts.items():
        n, s, q = (total[i] - part[i] for i in range(3))
        if n <= 0:
            continue
        cov = q / n - np.outer(s / n, s / n)
        with np.errstate(divide="ignore", invalid="ignore"):
            fit = np.nan_to_num(cov[:-1, -1] ** 2 / (np.diag(cov)[:-1] * cov[-1, -1]), nan=-1.0)
        best = max(range(len(features)), key=lambda i: (fit[i], i))
        slope = cov[best, -1] / cov[best, best] if cov[best, best] > 0 else 0.0
        lines.append((f, best, float(slope), float(s[-1] / n - slope * s[best] / n)))
    coef = df.sparkSession.createDataFrame(lines, f"{fold} {dict(df.dtypes)[fold]}, _f int, _b double, _a double")
    x = F.get(F.array(*(F.col(f).cast("double") for f in features)), F.col("_f"))
    return df.join(F.broadcast(coef), fold, "left").withColumn(name, F.col("_a") + F.col("_b") * x).drop("_f", "_b", "_a")


def single_proxy(df: DataFrame, features: list[str], y: str, is_train: Column) -> DataFrame:
    """(feature, slope, intercept, train_r2), the feature whose one-variable line fits the training rows best; ties by name."""
    own = df.filter(is_train & F.col(y).isNotNull())
    long = own.select(F.col(y).alias("_y"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("o")).select("_y", "o.*").dropna()
    fits = long.groupBy("feature").agg(F.regr_slope("_y", "x").alias("slope"), F.regr_intercept("_y", "x").alias("intercept"), F.pow(F.corr("_y", "x"), 2).alias("train_r2"))
    return fits.filter(F.col("slope").isNotNull()).orderBy(F.desc("train_r2"), "feature").limit(1)
