"""Forests whose trees are grown whole, against brute force and the model contract."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarmac import presets
from tarmac.operators import deepforest, models
from tarmac.sources import fitted


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 4)).round(1)
    y = np.where(x[:, 0] * x[:, 2] > 0.8, "Fatal", np.where(x[:, 0] > 0.3, "Serious", "Slight"))
    return spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(y=y)).repartition(5)


def key_of(node, bins, y, count, classes):
    shift = max(1, (classes - 1).bit_length()) + 4
    return (node << (shift + 6) | bins.astype(np.int64) << shift | y << 4 | count).astype(np.uint64)


def test_best_splits_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n, weights = 120, np.array([3.0, 1.0, 0.5])
        node, bins, y, count = np.sort(rng.integers(0, 3, n)), rng.integers(1, 7, n), rng.integers(0, 3, n), rng.integers(1, 4, n)

        def impurity(rows):
            c = np.bincount(y[rows], weights=count[rows], minlength=3) * weights
            return c.sum() - (c**2).sum() / c.sum(), c.sum()

        def fall(k, cut):
            left, right = (node == k) & (bins <= cut), (node == k) & (bins > cut)
            if count[left].sum() < 5 or count[right].sum() < 5:
                return -1.0
            whole, total = impurity(node == k)
            return (whole - impurity(left)[0] - impurity(right)[0]) / total

        best, at = deepforest._sorted_splits(key_of(node, bins, y, count, 3), weights, 5)
        for k in range(3):
            assert best[k] == pytest.approx(max(fall(k, c) for c in range(1, 7))) and best[k] == pytest.approx(fall(k, at[k]))
        again, same = deepforest._dense_splits((node << 6 | bins) * 3 + y, 3, count, weights, 5)
        np.testing.assert_allclose(best, again)
        assert at[best > 0].tolist() == same[best > 0].tolist()


def test_trees_separate_what_the_features_tell():
    rng = np.random.default_rng(2)
    bins = rng.integers(1, 20, (3000, 3)).astype(np.uint8)
    y = (bins[:, 0] > 9).astype(np.int64) + (bins[:, 1] > 14)
    tree = deepforest.grow(bins, y, 3, np.ones(3), 20, 2, np.random.default_rng(0))
    assert (tree.shares(bins).argmax(axis=1) == y).mean() > 0.99
    inner = np.flatnonzero(tree.left != np.arange(len(tree.left)))
    ends = tree.left == np.arange(len(tree.left))
    told = tree.share.argmax(axis=1)
    assert not any(ends[i] and ends[i + 1] and told[i] == told[i + 1] for i in tree.left[inner])
    shallow = deepforest.grow(bins, y, 3, np.ones(3), 1, 2, np.random.default_rng(0))
    assert shallow.depth == 1 and len(shallow.left) == 3
    alone = deepforest.grow(bins, np.zeros(3000, dtype=np.int64), 3, np.ones(3), 20, 2, np.random.default_rng(0))
    assert alone.depth == 0 and alone.shares(bins[:5])[:, 0].tolist() == [1.0] * 5
    coarse = deepforest.grow(bins, y, 3, np.ones(3), 20, 4000, np.random.default_rng(0))
    assert len(coarse.left) == 1


def test_large_deep_forests_grow_a_tree_a_task(spark, rows, monkeypatch, tmp_path):
    """Passes over all rows for every group of nodes do not end within minutes on 900,000 rows."""
    monkeypatch.setattr(models, "DEEP_ROWS_PER_TASK", 1_000)
    fit = lambda df, **k: models.fit_forest(df, "y", list("abcd"), trees=6, depth=20, **k)
    model, again = fit(rows), fit(rows.repartition(3))
    assert isinstance(model, models.Deep) and len(model.forest.trees) == 6 and model.stages == []
    told, other = (m.transform(rows).select("a", "b", "c", "d", "y", "prediction", "probabilities").toPandas() for m in (model, again))
    p = np.vstack(told["probabilities"])
    np.testing.assert_allclose(p.sum(axis=1), 1.0)
    assert [presets.LABELS[i] for i in p.argmax(axis=1)] == list(told["prediction"])
    assert (told["prediction"] == told["y"]).mean() > 0.9
    order = list("abcd")
    np.testing.assert_array_equal(np.vstack(told.sort_values(order)["probabilities"]), np.vstack(other.sort_values(order)["probabilities"]))
    heavy = fit(rows, weights={"Fatal": 50.0}).transform(rows).where("prediction = 'Fatal'").count()
    assert heavy > (told["prediction"] == "Fatal").sum()
    assert not isinstance(models.fit_forest(rows, "y", list("abcd"), trees=2, depth=6), models.Deep)
    monkeypatch.setattr(deepforest, "MAX_ROWS", 1_100)
    assert not isinstance(models.fit_forest(rows, "y", list("abcd"), trees=2, depth=12), models.Deep)
    path = str(tmp_path / "models")
    own = fitted.Fitted(model, None, [0.2, 0.3, 0.4])
    fitted.save(spark, path, own)
    keep = [*order, "prediction", "confidence"]
    assert sorted(own.transform(rows).select(keep).collect()) == sorted(fitted.load(spark, path).transform(rows).select(keep).collect())


def test_missing_values_are_refused_as_by_small_forests(rows, monkeypatch):
    monkeypatch.setattr(models, "DEEP_ROWS_PER_TASK", 1_000)
    with pytest.raises(ValueError, match="missing"):
        models.fit_forest(rows.withColumn("a", F.when(F.col("b") < 2, F.col("a"))), "y", list("abcd"), trees=2, depth=12)
