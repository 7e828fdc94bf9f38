"""Random draws, iterative methods, skew paths and plans, against brute force or invariants."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarmac import presets, schema
from tarmac.catalog import registry
from tarmac.functions import scalar as fx
from tarmac.operators import balance, clean, correlation, features, impute, isolation, joins, models, neighbours, normality
from tarmac.operators import order_stats, select, skew, tuning
from tarmac.plans import flows
from tarmac.session import cut_lineage, new_path, scratch_dir
from tarmac.sources import domain, snapshots, tables


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    n = 700
    base = rng.normal(size=(n, 3)) + rng.integers(0, 3, size=(n, 1)) * 3
    base[600:] = base[5]  # a large group of copies
    frame = pd.DataFrame(base, columns=["a", "b", "c"]).assign(id=np.arange(n), y=np.where(rng.random(n) < 0.15, "rare", "common"))
    return spark.createDataFrame(frame), frame


def brute_knn(frame, k, within=True):
    x, y = frame[["a", "b", "c"]].to_numpy(), frame["y"].to_numpy()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    d[np.arange(len(x)), np.arange(len(x))] = np.inf
    if within:
        d[y[:, None] != y[None, :]] = np.inf
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("chunk_rows", [10_000, 60, 17])
def test_knn_matches_brute_force_with_copies(spark, points, chunk_rows):
    df, frame = points
    vectors = df.select("id", "y", F.array("a", "b", "c").alias("v"))
    out = neighbours.knn(vectors, "id", "v", 4, within="y", chunk_rows=chunk_rows, visitors=50).toPandas().sort_values(["id", "rank"])
    assert len(out) == 4 * len(frame)
    np.testing.assert_allclose(out["distance"].to_numpy().reshape(-1, 4), brute_knn(frame, 4), atol=1e-9)
    labels = frame.set_index("id")["y"]
    assert (labels.loc[out["id"]].to_numpy() == labels.loc[out["neighbour"]].to_numpy()).all()
    assert (out["id"] != out["neighbour"]).all()


@pytest.mark.parametrize("trips", ["blocks", "one block", "leaves"])
def test_knn_by_blocks_and_by_leaves(spark, points, monkeypatch, trips):
    """Rows that would visit most leaves travel once per block; either way neighbours are exact."""
    df, frame = points
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", {"blocks": 150, "one block": 32_768, "leaves": 5}[trips])
    used, by_blocks = [], neighbours._by_blocks
    monkeypatch.setattr(neighbours, "_by_blocks", lambda *a: used.append(1) or by_blocks(*a))
    vectors = df.select("id", "y", F.array("a", "b", "c").alias("v"))
    out = neighbours.knn(vectors, "id", "v", 4, within="y", chunk_rows=12, visitors=50).toPandas().sort_values(["id", "rank"])
    assert len(used) == (trips != "leaves") and len(out) == 4 * len(frame)
    np.testing.assert_allclose(out["distance"].to_numpy().reshape(-1, 4), brute_knn(frame, 4), atol=1e-9)
    assert (out["id"] != out["neighbour"]).all() and not out.duplicated(["id", "neighbour"]).any()


def test_neighbours_are_searched_once(spark, points, monkeypatch):
    """Joins that look for hot keys read their input twice; the search before them must not run twice."""
    df, frame = points
    searches, knn = [], balance.knn
    ran = spark.sparkContext.accumulator(0)

    def counted(*args, **options):
        def seen(batches):
            for batch in batches:
                ran.add(len(batch))
                yield batch

        found = knn(*args, **options)
        searches.append(1)
        return found.mapInPandas(seen, found.schema)

    monkeypatch.setattr(balance, "knn", counted)
    balance.tomek_links(df, "y", "id", ["a", "b", "c"]).collect()
    assert len(searches) == 1 and ran.value == len(frame)


def test_knn_by_blocks_counts_repeated_keys_as_a_join_does(spark):
    """Rows of one key were joined to their vectors by key, so each of them came back several times."""
    x = np.random.default_rng(8).normal(size=(120, 2))
    ids = np.concatenate([np.arange(110), np.arange(10)])
    frame = pd.DataFrame({"id": ids, "v": list(x[ids])})
    out = neighbours.knn(spark.createDataFrame(frame), "id", "v", 3, chunk_rows=10).toPandas().sort_values(["id", "rank"])
    d = np.round(np.sqrt(((x[ids][:, None] - x[ids][None]) ** 2).sum(axis=2)), 12)
    d[ids[:, None] == ids[None, :]] = np.inf
    wanted = [np.sort(np.concatenate(d[ids == i]))[:3] for i in range(110)]
    np.testing.assert_allclose(out["distance"].to_numpy().reshape(-1, 3), wanted, atol=1e-9)


def test_tree_levels_and_visits_grow_with_the_rows(spark):
    visits, levels = [], []
    for n in (300, 1_200, 4_800):
        x = np.random.default_rng(n).random((n, 2))
        kth = np.concatenate([np.partition(((part[:, None] - x[None]) ** 2).sum(axis=2), 3, axis=1)[:, 3] for part in np.array_split(x, 20)]) ** 0.5
        frame = pd.DataFrame({"id": np.arange(n), "g": "g", "v": list(x), "kth": kth})
        rows = cut_lineage(spark.createDataFrame(frame).withColumn("h", fx.unit_hash(F.col("id"))))
        placed, nodes, depth = neighbours.grow_tree(rows.drop("kth"), "bigint", 8)
        assert placed.count() == n and placed.select("id").distinct().count() == n
        assert nodes.groupBy("parent").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= neighbours.FAN
        visits.append(neighbours.find_visits(rows.select("id", "g", "kth"), placed, nodes, depth, 3, "bigint").count())
        levels.append(depth)
    assert levels[0] < levels[-1] and levels[-1] >= 3
    for few, many in zip(visits, visits[1:]):
        assert many < few * 4**1.5


def test_station_tree_visits_few_leaves():
    rng = np.random.default_rng(4)
    sites = joins._unit(rng.uniform(-90, 90, 100_000), rng.uniform(-180, 180, 100_000))
    splits = joins.median_splits(sites, 2048)
    leaf = joins.leaf_of(sites, splits)
    sizes = np.bincount(leaf, minlength=2048)
    assert len(splits) == 2047 and sizes.min() >= 40 and sizes.max() <= 60
    low, high = (np.stack([f.reduceat(sites[np.argsort(leaf, kind="stable")], np.cumsum(sizes) - sizes, axis=0)])[0] for f in (np.minimum, np.maximum))
    places = joins._unit(rng.uniform(-90, 90, 500), rng.uniform(-180, 180, 500))
    i, j = joins.leaves_to_visit(places, low, high)
    nearest = np.array([((sites - p) ** 2).sum(axis=1).argmin() for p in places])
    visited = set(zip(i.tolist(), j.tolist(), strict=True))
    assert all((n, leaf[s]) in visited for n, s in enumerate(nearest)) and len(i) / 500 < 30


def test_smote_reaches_targets_on_segments(spark, points):
    df, frame = points
    out = balance.smote(df, "y", "id", ["a", "b", "c"], k=3).toPandas()
    sizes = out.groupby("y").size()
    assert sizes["rare"] == sizes["common"] == (frame["y"] == "common").sum()
    rare = frame[frame["y"] == "rare"].set_index("id")[["a", "b", "c"]]
    for _, row in out[out["is_synthetic"] == 1].iterrows():
        start = rare.loc[int(row["id"].split(":")[1])].to_numpy()
        move = row[["a", "b", "c"]].to_numpy(float) - start
        ends = rare.to_numpy() - start
        length = (ends**2).sum(axis=1)
        t = np.divide(ends @ move, length, out=np.zeros(len(ends)), where=length > 0)
        off = np.abs(ends * t[:, None] - move).max(axis=1)
        assert ((off < 1e-9) & (t >= -1e-9) & (t <= 1 + 1e-9)).any()


def test_smote_edge_cases(spark):
    df = spark.createDataFrame([(i, "a" if i else "b", float(i)) for i in range(5)], "id int, y string, x double")
    with pytest.raises(ValueError, match="one row"):
        balance.smote(df, "y", "id", ["x"])
    assert balance.smote(df, "y", "id", ["x"], {"a": 2}).count() == 5
    many = balance.smote(df.where("y = 'a'").union(df.where("y = 'a'").withColumn("id", F.col("id") + 10).withColumn("y", F.lit("b")).limit(2)), "y", "id", ["x"], {"b": 25_003})
    assert many.where("y = 'b'").count() == 25_003


def test_tomek_links_match_brute_force(spark, points):
    df, frame = points
    df, frame = df.where("id < 600"), frame[frame["id"] < 600]
    x, y = frame[["a", "b", "c"]].to_numpy(), frame["y"].to_numpy()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = d.argmin(axis=1)
    want = {(i, j) for i, j in enumerate(near) if near[j] == i and y[i] != y[j] and i < j}
    found = balance.tomek_links(df, "y", "id", ["a", "b", "c"], chunk_rows=100).collect()
    assert {(r["left_key"], r["right_key"]) for r in found} == want
    left = balance.remove_tomek_links(df, "y", "id", ["a", "b", "c"])
    assert left.count() == 600 - 2 * len(want)


def test_split_is_exact_disjoint_and_partition_independent(spark, points):
    df, frame = points
    split = balance.train_val_test(df, "y", "id")
    counts = {(r["split"], r["y"]): r["count"] for r in split.groupBy("split", "y").count().collect()}
    for label, n in frame.groupby("y").size().items():
        assert counts[("test", label)] == int(n * 0.2 + 0.5)
        assert counts[("test", label)] + counts[("val", label)] == int(n * 0.6 + 0.5)
    again = balance.train_val_test(df.repartition(7), "y", "id")
    assert split.select("id", "split").exceptAll(again.select("id", "split")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 137, 700, 900])
def test_sample_has_exact_size(spark, points, n):
    assert balance.fixed_size_sample(points[0], "id", n).count() == min(n, 700)


def test_sample_of_a_hot_key_has_exact_size(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 600, 1).otherwise(F.col("id")).alias("k"))
    for n in (10, 300, 650):
        assert balance.fixed_size_sample(df, "k", n).count() == n


def test_quantiles_agree_on_both_paths(spark, points):
    df, frame = points
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    small = order_stats.exact_quantiles(df, ["a", "b"], probs)
    large = order_stats.exact_quantiles(df, ["a", "b"], probs, state_limit=0)
    for c in ("a", "b"):
        np.testing.assert_allclose(small[c], frame[c].quantile(probs), rtol=1e-12)
        np.testing.assert_allclose(large[c], frame[c].quantile(probs), rtol=1e-12)
    assert order_stats.exact_quantiles(df.withColumn("z", F.lit(None).cast("double")), ["z"], [0.5], state_limit=0) == {"z": [None]}
    approx = order_stats.exact_quantiles(df, ["a"], [0.5], approx=True)["a"][0]
    assert abs((frame["a"] <= approx).mean() - 0.5) < 0.02


def test_ranks_and_spearman(spark, points):
    df, frame = points
    ranks = order_stats.average_ranks(df, ["a"]).toPandas().set_index("value")["rank"]
    want = frame["a"].rank()
    np.testing.assert_allclose(ranks.loc[frame["a"]].to_numpy(), want)
    for limit in (100_000, 0):
        r = correlation.spearman_pairs(df, ["a", "b"], limit=limit).first()["spearman"]
        assert r == pytest.approx(frame["a"].rank().corr(frame["b"].rank()), abs=1e-12)


def test_ks_statistic(spark, points):
    import math

    df, frame = points
    row = normality.ks_normal(df, ["a"]).first()
    x = np.sort(frame["a"].to_numpy())
    cdf = np.array([0.5 * (1 + math.erf((v - x.mean()) / (x.std(ddof=1) * math.sqrt(2)))) for v in x])
    n = len(x)
    want = max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max())
    assert row["statistic"] == pytest.approx(want, abs=1e-9)
    assert 0.0 <= row["p_value"] <= 1.0
    assert normality.ks_normal(df.limit(5), ["a"]).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_grid_search_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    stations = pd.DataFrame({"station_id": np.arange(120), "latitude": 50 + rng.random(120) * 0.01, "longitude": rng.random(120) * 0.01})
    far = pd.DataFrame({"station_id": np.arange(200, 240), "latitude": rng.uniform(-70, 75, 40), "longitude": rng.uniform(-180, 180, 40)})
    stations = pd.concat([stations, far], ignore_index=True)
    spots = pd.DataFrame({"Latitude": rng.uniform(-85, 85, 150), "Longitude": rng.uniform(-180, 180, 150)})
    near = pd.DataFrame({"Latitude": 50 + rng.random(100) * 0.02, "Longitude": rng.random(100) * 0.02})
    places = spark.createDataFrame(pd.concat([spots, near]))
    sites = spark.createDataFrame(stations)
    a = joins.nearest_station_join(places, sites, max_broadcast=0).toPandas().sort_values(["Latitude", "Longitude"])
    b = joins.nearest_station_join(places, sites).toPandas().sort_values(["Latitude", "Longitude"])
    assert len(a) == len(b) == 250
    np.testing.assert_allclose(a["distance_km"].to_numpy(), b["distance_km"].to_numpy(), atol=2e-6)
    assert (a["station_id"].to_numpy() == b["station_id"].to_numpy()).all()


def test_null_coordinates_get_no_station(spark):
    places = spark.createDataFrame([(51.0, None), (None, 0.0), (51.0, 0.0)], "Latitude double, Longitude double")
    sites = spark.createDataFrame([(1, 51.0, 0.1)], "station_id int, latitude double, longitude double")
    assert joins.nearest_station_join(places, sites).count() == 1


@pytest.fixture(scope="module")
def hot(spark):
    many = spark.range(3000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v")
    )
    one = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    return many, one


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("options", [{}, {"detect": False, "null_keys": True}])
def test_lookup_join_keeps_results_under_skew(spark, hot, how, options):
    many, one = hot
    assert list(skew.hot_keys(many, ["k"], 500, 0).values())
    want = many.join(one, ["k"], how)
    got = skew.join_lookup(many, one, ["k"], how, rows_per_salt=100, small_bytes=0, **options)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_detail_join_keeps_results_under_skew(spark, hot, how):
    many, one = hot
    want = one.join(many, ["k"], how)
    got = skew.join_details(one, many, ["k"], how, rows_per_salt=100, small_bytes=0)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_key_rows_spread_over_salts(spark, hot):
    many, _ = hot
    found = skew.hot_keys(many, ["k"], 100, 0)
    spread = skew._spread(many, ["k"], found).where("k = 7").groupBy("_salt").count().collect()
    assert len(spread) > 1


def test_fill_forward_back_over_many_ranges(spark):
    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.7 else float(i) for i in range(500)]
    values[:40] = [None] * 40
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double").repartition(5)
    out = [r["x"] for r in impute.fill_forward_back(df, ["x"], "i", ranges=9).orderBy("i").collect()]
    want = pd.Series(values, dtype=float).ffill().bfill()
    np.testing.assert_array_equal(out, want)


def test_many_label_levels_take_the_distributed_path(spark):
    df = spark.createDataFrame([(i, f"v{i * 37 % 100:03d}" if i % 50 else None) for i in range(300)], "i int, x string")
    small = impute.label_encode(df, "x")
    large = impute.label_encode(df, "x", held_bytes=0)
    assert small.exceptAll(large).count() == 0 and large.count() == 300
    assert large.agg(F.max("x")).first()[0] == df.select(F.coalesce("x", F.lit("None"))).distinct().count() - 1


def test_thirty_columns_are_encoded_by_one_dictionary(spark):
    names = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame([(i, *[None if (i + j) % 13 == 0 else f"v{i * j % 7}" for j in range(30)]) for i in range(60)], "id int, " + ", ".join(f"{c} string" for c in names))
    tracker, group = spark.sparkContext.statusTracker(), "encode"
    spark.sparkContext.setJobGroup(group, group)
    out = impute.encode_categorical(df, names, method="label")
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs <= 6 and out.columns == df.columns  # the dictionary, its sizes and its rows; adaptive stages are jobs of their own
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    told, given = out.toPandas().sort_values("id"), df.toPandas().sort_values("id")
    for c in names:
        text = given[c].fillna("None")
        assert told[c].tolist() == text.map({v: n for n, v in enumerate(sorted(set(text)))}).tolist()
    nothing = impute.encode_categorical(df.limit(0), names[:2], method="label")
    assert nothing.count() == 0 and dict(nothing.dtypes)["c0"] == "bigint"


def test_isolation_rate_and_skips(spark, points):
    df, _ = points
    row = isolation.anomaly_rate(df, ["a", "b", "c"], "id", trees=50).first()
    assert row["sample_size"] == 700 and 3.0 <= row["rate_pct"] <= 5.5
    assert isolation.isolation_forest(df, ["a"], "id") is None
    assert isolation.isolation_forest(df.limit(50), ["a", "b"], "id") is None
    far = df.unionByName(spark.createDataFrame([(500.0, 500.0, 500.0, 9999, "common")], "a double, b double, c double, id long, y string"))
    top = isolation.isolation_forest(far, ["a", "b", "c"], "id", trees=50).orderBy(F.desc("anomaly_score")).first()
    assert top["id"] == 9999


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    n = 900
    y = rng.choice(presets.LABELS, size=n, p=[0.1, 0.25, 0.65])
    shift = pd.Series(y).map({"Fatal": 2.0, "Serious": 1.0, "Slight": 0.0}).to_numpy()
    frame = pd.DataFrame({"id": np.arange(n), "y": y, "good": shift + rng.normal(size=n) * 0.5, "noise": rng.normal(size=n), "extra": rng.normal(size=n)})
    frame["copy"] = frame["good"] * 2 + rng.normal(size=n) * 0.01
    frame["Number_of_Casualties"] = shift
    return spark.createDataFrame(frame).withColumn("code", features.fx.lookup("y", presets.LABEL_CODES).cast("double"))


def test_selection_leaves_out_leakage_and_refills(labelled):
    names = ["good", "noise", "extra", "copy", "Number_of_Casualties"]
    kept, table = select.select_model_based(labelled, names, "code", top_k=2, trees=20, depth=5)
    assert len(kept) == 2 and "Number_of_Casualties" not in kept
    assert len({"good", "copy"} & set(kept)) == 1
    kept, ranking = select.select_rfecv(labelled, names, "y", "id", min_features=2, step=1, folds=3, max_iter=20)
    assert "Number_of_Casualties" not in kept and {"good", "copy"} & set(kept)
    assert not {"good", "copy"} <= set(kept)
    assert {r["feature"] for r in ranking.collect()} == {"good", "noise", "extra", "copy"}


def test_rfecv_needs_two_classes(labelled):
    with pytest.raises(ValueError, match="two classes"):
        select.select_rfecv(labelled.where("y = 'Slight'"), ["good", "noise"], "y", "id")


def test_statistical_selection(labelled):
    for method in ("pearson", "spearman", "mutual_info"):
        kept, table = select.select_statistical(labelled, ["good", "noise", "extra"], "code", method, top_k=1)
        assert kept == ["good"]
    p = {r["feature"]: r["p_value"] for r in select.select_statistical(labelled, ["good", "noise"], "code", "spearman")[1].collect()}
    assert p["good"] < 1e-6 and p["noise"] > 1e-4


def test_student_p_value():
    # r = 0.5 with 20 rows: t = 2.4495, two-sided p = 0.02473
    assert select._student_p(0.5, 20) == pytest.approx(0.024769, abs=2e-5)
    assert select._student_p(0.0, 20) == pytest.approx(1.0)


@pytest.mark.parametrize("fit", ["logistic", "forest", "boosted"])
def test_model_contract(labelled, fit):
    features_ = ["good", "noise"]
    model = {
        "logistic": lambda: models.fit_logistic(labelled, "y", features_, max_iter=20),
        "forest": lambda: models.fit_forest(labelled, "y", features_, trees=10, depth=4),
        "boosted": lambda: models.fit_boosted(labelled, "y", features_, iterations=3, depth=2),
    }[fit]()
    out = model.transform(labelled).select("y", "prediction", "probabilities", "confidence", "probability_map").toPandas()
    assert set(out["prediction"]) <= set(presets.LABELS)
    p = np.vstack(out["probabilities"])
    np.testing.assert_allclose(p.sum(axis=1), 1.0)
    assert (out["confidence"] == p.max(axis=1)).all()
    assert [presets.LABELS[i] for i in p.argmax(axis=1)] == list(out["prediction"])
    assert (out["y"] == out["prediction"]).mean() > 0.6


def test_missing_class_keeps_its_place(labelled):
    two = labelled.where("y <> 'Fatal'")
    model = models.fit_logistic(two, "y", ["good"], max_iter=10)
    row = model.transform(two).first()
    assert len(row["probabilities"]) == 3 and row["probabilities"][0] < 0.05
    with pytest.raises(ValueError, match="missing"):
        models.fit_logistic(two, "y", ["good"], require_all=True)
    with pytest.raises(ValueError, match="unexpected"):
        models.fit_logistic(labelled.withColumn("y", F.lit("what")), "y", ["good"])


def test_baselines(labelled):
    uniform = models.baseline(labelled, labelled, "y", "id", "uniform").groupBy("prediction").count().collect()
    assert all(200 < r["count"] < 400 for r in uniform) and len(uniform) == 3
    assert models.baseline(labelled, labelled, "y", "id", "most_frequent").first()["prediction"] == "Slight"
    with pytest.raises(ValueError):
        models.baseline(labelled, labelled, "y", "id", "constant")


def test_search_draws_are_seeded(labelled):
    import random

    a = tuning.draw_trial(presets.BOOSTED_SPACE, random.Random(1))
    assert a == tuning.draw_trial(presets.BOOSTED_SPACE, random.Random(1))
    assert 0.01 <= a["step"] <= 0.15 and a["depth"] in (4, 6, 8, 10)
    model, trials, thresholds = models.hyperparameter_search(
        labelled, labelled, "y", ["good"], trials=2, overrides={"iterations": 2, "depth": 2}, grid=[(0.1, 0.2, 0.3), (0.33, 0.33, 0.33)]
    )
    scores = [r["macro_f1"] for r in models.top_trials(trials).collect()]
    assert scores == sorted(scores, reverse=True) and len(thresholds) == 3 and model.params["depth"] == 2


def test_resampling_touches_training_rows_only(labelled):
    prepared = flows.split_balance_scale(labelled.select("id", "y", "good", "noise"), "y", "id", ["good", "noise"])
    rows = prepared.rows.toPandas()
    assert set(rows.loc[rows["is_synthetic"] == 1, "split"]) == {"train"}
    train = rows[rows["split"] == "train"]
    assert train.groupby("y").size().nunique() == 1
    np.testing.assert_allclose(train[["good", "noise"]].mean(), 0, atol=1e-9)
    np.testing.assert_allclose(train[["good", "noise"]].std(ddof=0), 1, atol=1e-9)
    ids = rows[rows["is_synthetic"] == 0].groupby("id")["split"].nunique()
    assert ids.max() == 1 and len(ids) == 900


def test_missing_input_fails_with_its_path(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="absent"):
        tables.require_inputs(spark, [str(tmp_path / "absent.parquet")])


def test_csv_is_latin1_and_names_are_safe(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes("1st_Road_Class,Engine_Capacity_.CC.,Local_Authority_(District)\nA,x12,Ynys M\xf4n\nB,1400,\n".encode("latin-1"))
    df = tables.read_csv(spark, str(path), "a string, b int, c string")
    raw = tables.read_csv_as_text(spark, str(path))
    assert raw.columns == ["X1st_Road_Class", "Engine_Capacity_CC", "Local_Authority_District"]
    assert [tuple(r) for r in df.collect()] == [("A", None, "Ynys M\xf4n"), ("B", 1400, None)]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r["x"] for r in schema.nan_to_null(df).collect()] == [None, 1.0]


def test_cache_is_reused_and_checked(spark):
    path = new_path(spark, "cache")
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("Fatal",)] * 10 + [("Slight",)] * 90, "y string")

    snapshots.read_or_create(spark, path, build)
    snapshots.read_or_create(spark, path, build, lambda df: snapshots.check_balanced(df, "y", {"Fatal": 10}))
    assert len(calls) == 1
    with pytest.raises(RuntimeError, match="expected at least"):
        snapshots.read_or_create(spark, path, build, lambda df: snapshots.check_balanced(df, "y", {"Fatal": 100}))
    with pytest.raises(RuntimeError, match="balance"):
        snapshots.check_balanced(build(), "y", {}, min_percent=50.0)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_in_the_jvm_without_windows_or_cross_joins(spark, sf_dir):
    merged = joins.merge_details(domain.view(spark, sf_dir, "accidents_admin"), domain.view(spark, sf_dir, "vehicles"))
    text = plan(flows.engineer(merged))
    for word in ("Window", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text, word


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(clean.filter_valid_set(domain.table(spark, sf_dir, "orders"), "o_orderstatus", ["F"]).select("o_orderkey"))
    assert "PushedFilters: [In(o_orderstatus" in text or "EqualTo(o_orderstatus" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text


def test_cleaning_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    columns = ["Accident_Index", "Latitude", "Longitude", "Day_of_Week", "Date", "Age_Band_of_Driver", "Sex_of_Driver"]
    rows = spark.range(5).select(F.col("id").alias("Speed_limit"), *[F.lit("1").alias(c) for c in columns])
    rows.write.parquet(path)
    text = plan(clean.clean(spark.read.parquet(path)))
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line)
    assert "In(Speed_limit" in pushed and "IsNotNull(Latitude)" in pushed and "CollectMetrics" not in text


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_dir(master)
    assert scratch_dir("local[4]") == scratch_dir("local")


def test_relational_partitions_are_named_whole(spark):
    with pytest.raises(ValueError, match="bounds"):
        tables.read_table(spark, "jdbc:none", "t", ["a"], partition_column="a")


def test_count_below(spark):
    limits = [-1.5, 0.0, 0.0, 2.0, 7.0]
    rows = spark.createDataFrame([(v,) for v in [-9.0, -1.5, 0.0, 1.0, 2.0, 7.0, 8.0, None]], "v double")
    for n in range(len(limits) + 1):
        array = F.array(*[F.lit(x) for x in limits[:n]]).cast("array<double>")
        for r in rows.select("v", fx.count_below(array, F.col("v")).alias("k")).collect():
            assert r.k == sum(r.v is not None and x < r.v for x in limits[:n])


def test_split_is_a_map_over_the_scan(spark, sf_dir):
    text = plan(balance.train_val_test(domain.view(spark, sf_dir, "accidents"), "Accident_Severity", "Accident_Index"))
    assert "Exchange" not in text and "Sort" not in text


def test_running_counts_place_values_and_not_rows(spark):
    """No filter on the place of a value is pushed below the counts, where it would search the limits once per row."""
    rows = spark.createDataFrame([(float(i % 7),) for i in range(50)], "x double").repartition(3)
    plan = order_stats.running_counts(order_stats.distinct_counts(rows, ["x"]))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "aggregate(" in line]

def test_queries_bound_generated_methods(spark, sf_dir):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "65535")
        registry.Data(spark, sf_dir)
        assert spark.conf.get(key) == "8000"
        spark.conf.set(key, "4000")
        registry.Data(spark, sf_dir)
        assert spark.conf.get(key) == "4000"
    finally:
        spark.conf.set(key, before)


def test_forest_rows_are_spread_where_a_partition_holds_many(spark):
    rows = spark.range(1_000, numPartitions=1).selectExpr("id", "CAST(id % 7 AS double) AS x")
    assert select._spread(rows, 1_000) is rows
    assert select._spread(rows.where("false"), 10).count() == 0
    even = select._spread(rows, 300)
    sizes = [r["count"] for r in even.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 300
    assert sorted(map(tuple, even.collect())) == sorted(map(tuple, rows.collect()))


def test_deep_forest_keeps_nodes_and_spreads_rows(spark, labelled, monkeypatch):
    monkeypatch.setattr(models, "DEEP_ROWS_PER_TASK", 100)
    rows = labelled.coalesce(1)
    n = rows.count()
    cores = spark.sparkContext.defaultParallelism
    assert models._forest_rows(rows, n, 10) is rows  # shallow: as before
    deep = models._forest_rows(rows, n, 20)
    assert 1 < deep.rdd.getNumPartitions() <= cores and deep.count() == n
    assert sorted(r["id"] for r in deep.select("id").collect()) == sorted(r["id"] for r in rows.select("id").collect())
    monkeypatch.setattr(models, "DEEP_ROWS_PER_TASK", 25_000)
    assert models._forest_rows(rows, n, 20) is rows  # few rows: as before
    kept = {d: models.fit_forest(rows, "y", ["good", "noise"], trees=2, depth=d).stages[0].stages[-1].getCacheNodeIds() for d in (4, 12)}
    assert kept == {4: False, 12: True}
