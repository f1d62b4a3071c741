"""Composite queries score every eligible fold, with learners of their full size."""

import pytest

from plumbline.operators import folds, learners, metrics
from plumbline.plans import composites, learning


class Stop(Exception):
    pass


@pytest.mark.parametrize("name", ["q3_group_collapse", "q5_exceedance_recovery"])
def test_every_row_of_an_eligible_fold_is_scored(spark, monkeypatch, name):
    asked, scored, whole, auc = [], [], folds.eligible_folds, metrics.auc

    def eligible(df, keys, *args, **kw):
        out = whole(df, keys, *args, **kw)
        asked.append((kw.get("cap"), out.agg({"n_test": "sum"}).first()[0], out.count()))
        return out

    def score(df, keys, label, column):
        scored.append((df.filter(df[column].isNotNull()).count(), df.select(*keys).distinct().count()))
        return auc(df, keys, label, column)

    monkeypatch.setattr(folds, "eligible_folds", eligible)
    monkeypatch.setattr(metrics, "auc", score)
    getattr(composites, name)(spark, "/root/testdata/sf0.001").collect()
    (cap, n_rows, n_folds), = asked
    assert cap is None and n_folds > 1 and set(scored) == {(n_rows, n_folds)}


@pytest.mark.parametrize("name", ["q9_learner_panel"])
def test_no_fold_is_left_out(spark, monkeypatch, name):
    asked, scored, whole = [], [], folds.eligible_folds

    def eligible(df, keys, *args, **kw):
        asked.append(kw.get("cap"))
        return whole(df, keys, *args, **kw)

    def fit(estimator, train, test, features, y, name="pred"):
        scored.append(estimator)
        raise Stop

    monkeypatch.setattr(folds, "eligible_folds", eligible)
    monkeypatch.setattr(learners, "fit_predict", fit)
    try:
        getattr(composites, name)(spark, "/root/testdata/sf0.001")
    except Stop:
        pass
    assert asked and set(asked) == {None}
    assert scored
    for m in scored:
        sizes = [m.getOrDefault(p) for p in ("numTrees", "maxIter") if m.hasParam(p)]
        assert max(sizes) >= 60


def test_panels_use_full_sized_learners(spark, monkeypatch):
    used = {}

    def fit(estimator, train, test, features, y, name="pred"):
        used[type(estimator).__name__] = [estimator.getOrDefault(p) for p in ("numTrees", "maxIter") if estimator.hasParam(p)][0]
        return test.withColumn(name, test[y].cast("double"))

    monkeypatch.setattr(learners, "fit_predict", fit)
    assert metrics and learning.l6_tree_panel(spark, "/root/testdata/sf0.001").count() == 2
    learning.l4_classifier_panel(spark, "/root/testdata/sf0.001")
    assert used["RandomForestRegressor"] == 200 and used["RandomForestClassifier"] == 150
    assert used["GBTRegressor"] == used["GBTClassifier"] == 60
