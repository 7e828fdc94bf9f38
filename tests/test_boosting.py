"""Boosted trees, their search, and stored models."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarmac import presets
from tarmac.operators import boosting, impute, models, tuning
from tarmac.sources import fitted


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 3))
    x[::17, 1] = np.nan
    y = np.where(x[:, 0] * x[:, 2] > 0.8, "Fatal", np.where(x[:, 0] > 0.3, "Serious", "Slight"))
    frame = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, held=np.arange(1500) % 5 == 0)
    return spark.createDataFrame(frame).repartition(4)


def test_interactions_are_learned_and_rounds_stop(rows):
    model = models.fit_boosted(rows, "y", ["a", "b", "c"], iterations=200, depth=4, validation=F.col("held"), patience=10)
    best = int(np.argmin(model.losses))
    assert len(model.forest.trees) == best and len(model.losses) <= best + 11
    assert min(model.losses) < 0.5 * model.losses[0]
    told = model.transform(rows.where("held")).toPandas()
    assert (told["prediction"] == told["y"]).mean() > 0.9


def test_passes_over_blocks_grow_the_same_trees(rows, monkeypatch):
    monkeypatch.setattr(boosting, "SCORE_EVERY", 2)
    monkeypatch.setattr(boosting, "_BLOCK_ROWS", 100)
    ready = rows.select(models.label_index("y", presets.LABELS).alias("_y"), F.lit(1.5).alias("_w"), F.col("held").alias("_held"), "a", "b", "c")
    settings = boosting.Settings(iterations=3, depth=2, subsample=0.7, feature_share=0.7, patience=3)
    near, losses = boosting.fit(ready, ["a", "b", "c"], 3, settings)
    far, again = boosting.fit(ready, ["a", "b", "c"], 3, settings, local_rows=0)
    assert [t[:2] for t in near.trees] == [t[:2] for t in far.trees] and len(near.trees) == 3
    for one, two in zip(near.trees, far.trees, strict=True):
        np.testing.assert_allclose(one[2], two[2], atol=1e-9)
    np.testing.assert_allclose(losses, again, atol=1e-9)


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_levels_of_a_pass_are_one_stage(spark, rows, monkeypatch, limit):
    """Small partial histograms need no shuffle; large ones are added up by feature. The trees are the same."""
    monkeypatch.setattr(boosting, "_COLLECT_BYTES", limit)
    monkeypatch.setattr(boosting, "_TASK_ROWS", 100)
    grouped = []
    whole = type(rows).groupBy
    ready = rows.select(models.label_index("y", presets.LABELS).alias("_y"), F.lit(1.5).alias("_w"), F.col("held").alias("_held"), "a", "b", "c")
    settings = boosting.Settings(iterations=2, depth=4, subsample=0.7, patience=3)
    near, losses = boosting.fit(ready, ["a", "b", "c"], 3, settings)
    monkeypatch.setattr(type(rows), "groupBy", lambda self, *by: grouped.append(by) or whole(self, *by))
    far, again = boosting.fit(ready, ["a", "b", "c"], 3, settings, local_rows=0)
    assert grouped.count(("feature",)) == (8 if limit == 0 else 0)
    assert [t[:2] for t in near.trees] == [t[:2] for t in far.trees] and len(near.trees) == 2
    for one, two in zip(near.trees, far.trees, strict=True):
        np.testing.assert_allclose(one[2], two[2], atol=1e-9)
    np.testing.assert_allclose(losses, again, atol=1e-9)


def test_one_of_two_siblings_is_counted(rows, monkeypatch):
    """The sums of the larger child follow from its parent's; trees are the same where every node is counted."""
    ready = rows.select(models.label_index("y", presets.LABELS).alias("_y"), F.lit(1.5).alias("_w"), F.col("held").alias("_held"), "a", "b", "c")
    settings, counted = boosting.Settings(iterations=2, depth=5, subsample=0.7, patience=3), []
    sums = boosting._sums
    monkeypatch.setattr(boosting, "_sums", lambda *a: counted.append(len(a[3])) or sums(*a))
    near, losses = boosting.fit(ready, ["a", "b", "c"], 3, settings)
    assert len(counted) == 10 and all(2 * n <= counted[0] for n in counted[1:5])
    level = boosting._Level.complete
    monkeypatch.setattr(boosting._Level, "complete", lambda self, *a: (level(self, *a), setattr(self, "sums", {}))[0])
    whole, again = boosting.fit(ready, ["a", "b", "c"], 3, settings)
    assert counted[10:15] == counted[:1] * 5
    monkeypatch.undo()
    monkeypatch.setattr(boosting, "_TASK_ROWS", 100)
    monkeypatch.setattr(boosting, "_COLLECT_BYTES", 100_000)  # sums fit the driver, those of all tasks do not; the last levels' do neither
    far, third = boosting.fit(ready, ["a", "b", "c"], 3, settings, local_rows=0)
    for other, own in ((whole, again), (far, third)):
        assert [t[:2] for t in near.trees] == [t[:2] for t in other.trees] and len(near.trees) == 2
        for one, two in zip(near.trees, other.trees, strict=True):
            np.testing.assert_allclose(one[2], two[2], atol=1e-9)
        np.testing.assert_allclose(losses, own, atol=1e-9)


def test_best_cut_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n, nodes = 80, 2
        bins, node = rng.integers(0, 6, n).astype(np.uint8), rng.integers(0, nodes, n)
        stats = np.hstack([rng.normal(size=(n, 2)), rng.random((n, 2)), np.ones((n, 1))])
        settings = boosting.Settings(l2=2.0, min_leaf=3)

        def value(rows):
            return (stats[rows, :2].sum(axis=0) ** 2 / (stats[rows, 2:4].sum(axis=0) + 2.0)).sum()

        def gain(cut):
            out = 0.0
            for k in range(nodes):
                left, right = (node == k) & (bins <= cut), (node == k) & (bins > cut)
                if left.sum() >= 3 and right.sum() >= 3:
                    out += value(left) + value(right) - value(node == k)
            return out

        got, at, ends = boosting.best_cut(boosting.histogram(bins, node, nodes, stats), settings)
        assert got == pytest.approx(max(gain(c) for c in range(7))) and got == pytest.approx(gain(at))
        np.testing.assert_allclose(ends[1, 0], stats[(node == 1) & (bins <= at)].sum(axis=0), atol=1e-9)


def test_edge_cases(spark, rows):
    none = models.fit_boosted(rows.withColumn("a", F.lit(1.0)), "y", ["a"], iterations=5, depth=2)
    assert none.forest.trees == [] and none.transform(rows.withColumn("a", F.lit(None).cast("double"))).select("prediction").distinct().count() == 1
    empty = models.fit_boosted(rows.limit(0), "y", ["a"], iterations=2, depth=2)
    assert empty.transform(rows).count() == 1500
    alone = models.fit_boosted(rows.where("y = 'Slight'"), "y", ["a", "b"], iterations=2, depth=2)
    assert {r.prediction for r in alone.transform(rows).select("prediction").collect()} == {"Slight"}


def test_proposals_move_to_good_values():
    space = {"x": (0.0, 1.0, "linear"), "kind": ["p", "q", "r"], "n": (1, 9, "int"), "s": (0.01, 1.0, "log")}
    rng = random.Random(2)
    known = []
    for _ in range(60):
        t = tuning.propose(space, known, rng)
        assert 0 <= t["x"] <= 1 and t["kind"] in space["kind"] and t["n"] in range(1, 10) and 0.01 <= t["s"] <= 1
        known.append((t, -abs(t["x"] - 0.7) - (t["kind"] != "q")))
    late = [t for t, _ in known[40:]]
    assert np.mean([abs(t["x"] - 0.7) for t in late]) < 0.12 and np.mean([t["kind"] == "q" for t in late]) > 0.7
    again, other = random.Random(5), random.Random(5)
    assert tuning.propose(space, known, again) == tuning.propose(space, known, other)


def test_trials_stop_at_rungs(rows):
    ready = rows.select(models.label_index("y", presets.LABELS).alias("_y"), F.lit(1.0).alias("_w"), F.col("held").alias("_held"), "a", "b", "c")
    forest, blocks = boosting.prepare(ready, ["a", "b", "c"], 3)
    block, grid = boosting.one_block(blocks), np.array([(0.2, 0.3, 0.3), (0.3, 0.3, 0.3)])
    params = {"iterations": 60, "depth": 2, "fatal_weight": 3.0}
    full = tuning.run_trial(block, forest, params, presets.LABELS, grid, {}, 1)
    cut = tuning.run_trial(block, forest, params, presets.LABELS, grid, {8: 1.1}, 1)
    assert cut["trees"] <= 8 < full["trees"] and full["rungs"][:2] != [tuning.NOT_REACHED] * 2
    assert cut["rungs"][0] == full["rungs"][0] and cut["rungs"][1] == tuning.NOT_REACHED
    assert full["macro_f1"] > 0.7


def test_trials_see_every_row(spark, monkeypatch):
    """A search on more than 200,000 rows drew that many of them; scores and thresholds came from the sample."""
    seen, whole = [], boosting.one_block
    monkeypatch.setattr(boosting, "one_block", lambda blocks: seen.append(whole(blocks)) or seen[-1])
    many = spark.range(210_000).selectExpr("CAST(pmod(xxhash64(id), 3) AS double) AS _y", "id % 5 = 0 AS _held", "CAST(pmod(xxhash64(id, 1), 40) AS double) AS a")
    tuning.search(many, ["a"], presets.LABELS, presets.BOOSTED_SPACE, [(0.3, 0.3, 0.3)], trials=1, overrides={"iterations": 1, "depth": 1})
    assert len(seen[0].y) == 210_000 and int(seen[0].held.sum()) == 42_000


def test_trials_on_the_cluster_are_those_of_tasks(rows, monkeypatch):
    """Rows that no task holds are searched whole as well, with the same trials."""
    monkeypatch.setattr(boosting, "_BLOCK_ROWS", 200)
    monkeypatch.setattr(boosting, "SCORE_EVERY", 3)
    ready = rows.select(models.label_index("y", presets.LABELS).alias("_y"), F.col("held").alias("_held"), "a", "b", "c")
    grid = [(a, 0.3, c) for a in (0.1, 0.3) for c in (0.2, 0.4)]
    ask = lambda **k: tuning.search(ready, ["a", "b", "c"], presets.LABELS, presets.BOOSTED_SPACE, grid, trials=3, batch=2, overrides={"iterations": 9, "depth": 2}, **k)
    near, far = ask(), ask(local_rows=0)
    assert [t["trial"] for t in near] == [t["trial"] for t in far] and len(far) == 3
    for one, two in zip(near, far, strict=True):
        assert one["params"] == two["params"] and one["trees"] == two["trees"] and one["thresholds"] == two["thresholds"]
        np.testing.assert_allclose([one["macro_f1"], *one["rungs"]], [two["macro_f1"], *two["rungs"]], atol=1e-9)


def test_macro_f1_by_hand():
    assert tuning.macro_f1(np.array([[2, 0, 0, 0, 1, 1, 0, 0, 0]]), 3)[0] == pytest.approx((1 + 2 / 3 + 0) / 3)


def test_saved_models_score_like_fitted_ones(spark, rows, tmp_path):
    filled = rows.fillna(0.0, ["b"])
    scaler = impute.Scaler.fit(filled, ["a", "b", "c"])
    with pytest.raises(FileNotFoundError):
        fitted.load(spark, str(tmp_path / "none"))
    path = str(tmp_path / "models")
    for n, model in enumerate((models.fit_logistic(scaler.transform(filled), "y", ["a", "b", "c"], max_iter=20), models.fit_boosted(scaler.transform(filled), "y", ["a", "b", "c"], iterations=4, depth=3)), 1):
        own = fitted.Fitted(model, scaler, [0.2, 0.3, 0.4])
        assert fitted.save(spark, path, own) == n
        read = fitted.load(spark, path)
        assert read.version == n and read.thresholds == own.thresholds
        keep = ["a", "c", "prediction", "confidence"]
        assert sorted(own.transform(filled).select(keep).collect()) == sorted(read.transform(filled).select(keep).collect())
    assert fitted.load(spark, path, 1).version == 1 and fitted.versions(spark, path) == [1, 2]
    with pytest.raises(FileNotFoundError):
        fitted.load(spark, path, 7)


def test_features_with_few_bins_share_a_pass_and_sum_the_same():
    rng = np.random.default_rng(3)
    widths, n, nodes, k = [7, 10, 3, 3, 33, 5], 2_000, 4, 3
    columns = [rng.integers(0, w, n).astype(np.uint8) for w in widths]
    node = rng.integers(0, nodes, n)
    scores = rng.normal(size=(n, k))
    block = boosting.Block(np.stack(columns, axis=1), rng.integers(0, k, n), rng.uniform(0.5, 2, n), np.zeros(n, bool), np.arange(n), scores)
    stats = boosting.gradients(block, boosting.Settings(), 0)
    assert len(boosting._bundles(widths, range(6), nodes)) < 6
    got = boosting._sums(columns, widths, range(6), node, nodes, np.ascontiguousarray(stats.T))
    for f, w in enumerate(widths):
        whole = boosting.histogram(columns[f], node, nodes, stats)
        np.testing.assert_allclose(got[f].reshape(nodes, w, -1), whole[:, :w], atol=1e-9)
