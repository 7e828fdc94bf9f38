"""Feature selection, anomaly detection, baselines, classifiers, tuning and batch scoring."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tarmac import presets
from tarmac.catalog.aggregates import ranked_sql
from tarmac.catalog.registry import case_map, query
from tarmac.functions import scalar as fx
from tarmac.operators import correlation, impute, isolation, models, select
from tarmac.operators import features as fe
from tarmac.plans import flows
from tarmac.session import new_path
from tarmac.sources import fitted

_FEATURES = ["Speed_limit", "road_risk_score", "is_dark", "is_wet_road", "is_urban", "Latitude", "Longitude", "Number_of_Vehicles", "Number_of_Casualties"]
_LABEL = "Accident_Severity"


def model_rows(d):
    """Complete numeric rows with a text label, one per accident."""
    out = fe.road_surface_flag(fe.lighting_features(fe.urban_flag(fe.road_risk_score(d.accidents))))
    out = out.where(F.col(_LABEL).isin(*presets.LABELS)).select("Accident_Index", _LABEL, *_FEATURES).dropna()
    return out.withColumns({c: F.col(c).cast("double") for c in _FEATURES})


_COMPLETE = f"""(SELECT CAST(Speed_limit AS DOUBLE) AS Speed_limit, Latitude, Longitude, CAST(Number_of_Casualties AS DOUBLE) AS Number_of_Casualties,
  CAST({case_map('Accident_Severity', presets.LABEL_CODES)} AS DOUBLE) AS y FROM accidents
  WHERE Speed_limit IS NOT NULL AND Latitude IS NOT NULL AND Longitude IS NOT NULL AND Accident_Severity IN ('Fatal', 'Serious', 'Slight'))"""
_STAT = ["Speed_limit", "Latitude", "Longitude", "Number_of_Casualties"]


def _stat_rows(d):
    rows = fe.encode_target(d.accidents).select(*_STAT, F.col(_LABEL).alias("y")).dropna()
    return rows.withColumns({c: F.col(c).cast("double") for c in [*_STAT, "y"]})


@query(
    "select_by_pearson",
    "feature:s score:f",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, y)) AS score FROM {_COMPLETE}" for c in _STAT),
    ["accidents"],
)
def select_by_pearson(d):
    return select.select_statistical(_stat_rows(d), _STAT, "y", "pearson")[1]


@query(
    "select_by_spearman",
    "feature:s score:f",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, y)) AS score FROM {ranked_sql([c, 'y'], _COMPLETE)}" for c in _STAT),
    ["accidents"],
)
def select_by_spearman(d):
    return select.select_statistical(_stat_rows(d), _STAT, "y", "spearman")[1]


_EDGES = ", ".join(f"{i / 10}e0" for i in range(11))


def _mi_sql(column, bins):
    binned = (
        f"1 + len(list_filter(list_slice((SELECT list_sort(list_distinct(quantile_cont({column}, [{_EDGES}]))) FROM {_COMPLETE}), 2, -2), lambda e: {column} > e))"
        if bins
        else column
    )
    return f"""SELECT '{column}' AS feature, sum(n / nt * ln(n * nt / (nb * ny))) AS mutual_info FROM (
      SELECT n, sum(n) OVER () AS nt, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY y) AS ny FROM (
        SELECT b, y, CAST(count(*) AS DOUBLE) AS n FROM (SELECT {binned} AS b, y FROM {_COMPLETE}) GROUP BY b, y))"""


@query(
    "mutual_information",
    "feature:s mutual_info:f",
    f"{_mi_sql('Speed_limit', False)} UNION ALL {_mi_sql('Latitude', True)} UNION ALL {_mi_sql('Number_of_Casualties', False)}",
    ["accidents"],
)
def mutual_information(d):
    return select.mutual_information(_stat_rows(d), ["Speed_limit", "Latitude", "Number_of_Casualties"], "y", discrete=["Speed_limit", "Number_of_Casualties"])


_RISK = f"""CAST(floor({case_map('Speed_limit', presets.SPEED_RISK, '3')} * {case_map("coalesce(Road_Type, 'Single carriageway')", presets.ROAD_RISK_MULTIPLIERS, '1e0')}) AS DOUBLE)"""


@query(
    "correlation_filter",
    "feature:s",
    f"""WITH t AS (SELECT CAST(Speed_limit AS DOUBLE) AS speed, {_RISK} AS risk, CAST(Number_of_Vehicles AS DOUBLE) AS vehicles FROM accidents WHERE Speed_limit IS NOT NULL)
        SELECT 'speed' AS feature FROM t HAVING NOT coalesce(abs(corr(speed, risk)) > 0.5e0, false)
        UNION ALL SELECT 'risk' FROM t HAVING NOT coalesce(abs(corr(risk, vehicles)) > 0.5e0, false)
        UNION ALL SELECT 'vehicles' FROM t HAVING NOT coalesce(abs(corr(speed, vehicles)) > 0.5e0, false)""",
    ["accidents"],
)
def correlation_filter(d):
    rows = fe.road_risk_score(d.accidents).where("Speed_limit IS NOT NULL")
    rows = rows.select(F.col("Speed_limit").alias("speed"), F.col("road_risk_score").alias("risk"), F.col("Number_of_Vehicles").alias("vehicles"))
    # Scores decide who goes: risk over vehicles over speed.
    kept = correlation.correlation_filter(rows, ["speed", "risk", "vehicles"], {"risk": 3.0, "vehicles": 2.0, "speed": 1.0}, 0.5)
    return d.spark.createDataFrame([(f,) for f in kept], "feature string")


@query("select_model_based", "feature:s score:f")
def select_model_based(d):
    rows = model_rows(d).withColumn("y", models.label_index(_LABEL, presets.LABELS))
    return select.select_model_based(rows, _FEATURES, "y", top_k=5)[1]


@query("select_rfecv", "feature:s ranking:i support:i score:f")
def select_rfecv(d):
    return select.select_rfecv(model_rows(d), _FEATURES, _LABEL, "Accident_Index", min_features=4)[1]


@query("compare_selectors", "method:s feature:s")
def compare_selectors(d):
    rows = model_rows(d).withColumn("y", models.label_index(_LABEL, presets.LABELS))
    found = select.compare_selectors(rows, _FEATURES, "y", "Accident_Index", min_features=5)
    pairs = [(m, f) for m in ("rfecv", "model_based", "selected", "common") for f in found[m]]
    return d.spark.createDataFrame(pairs, "method string, feature string")


@query("isolation_forest", "sample_size:i anomalies:i rate_pct:f")
def isolation_forest(d):
    return isolation.anomaly_rate(d.weather, ["wspd", "pres", "wpgt", "tsun"], ["station_id", "time"])


_KEPT = "Accident_Severity IN ('Fatal', 'Serious', 'Slight')"
_UNIT = "CAST('0x' || substr(md5('42:' || CAST(Accident_Index AS STRING)), 1, 15) AS BIGINT) / 1152921504606846976e0"


def _labelled(d):
    return d.accidents.where(F.col(_LABEL).isin(*presets.LABELS)).select("Accident_Index", _LABEL)


@query(
    "baseline_most_frequent",
    "Accident_Index:i prediction:s constant:s",
    f"""SELECT Accident_Index, (SELECT Accident_Severity FROM accidents WHERE {_KEPT} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS prediction, 'Slight' AS constant
        FROM accidents WHERE {_KEPT}""",
    ["accidents"],
)
def baseline_most_frequent(d):
    rows = _labelled(d)
    fixed = models.baseline(rows, rows, _LABEL, "Accident_Index", "constant", "Slight").withColumnRenamed("prediction", "constant")
    return models.baseline(rows, fixed, _LABEL, "Accident_Index", "most_frequent")


@query(
    "baseline_stratified",
    "Accident_Index:i prediction:s",
    f"""SELECT Accident_Index, CASE WHEN u < f THEN 'Fatal' WHEN u < f + s THEN 'Serious' ELSE 'Slight' END AS prediction FROM (
          SELECT Accident_Index, {_UNIT} AS u, (SELECT avg(CASE WHEN Accident_Severity = 'Fatal' THEN 1e0 ELSE 0e0 END) FROM accidents WHERE {_KEPT}) AS f,
            (SELECT avg(CASE WHEN Accident_Severity = 'Serious' THEN 1e0 ELSE 0e0 END) FROM accidents WHERE {_KEPT}) AS s FROM accidents WHERE {_KEPT})""",
    ["accidents"],
)
def baseline_stratified(d):
    rows = _labelled(d)
    return models.baseline(rows, rows, _LABEL, "Accident_Index", "stratified")


@query(
    "baseline_uniform",
    "Accident_Index:i prediction:s",
    f"""SELECT Accident_Index, CASE WHEN {_UNIT} < 1e0 / 3 THEN 'Fatal' WHEN {_UNIT} < 1e0 / 3 + 1e0 / 3 THEN 'Serious' ELSE 'Slight' END AS prediction
        FROM accidents WHERE {_KEPT}""",
    ["accidents"],
)
def baseline_uniform(d):
    rows = _labelled(d)
    return models.baseline(rows, rows, _LABEL, "Accident_Index", "uniform")


SCORED_SPEC = "Accident_Index:i has_label:i sums_to_one:i follows_scores:i confidence_is_largest:i"
_ELIGIBLE = f"""FROM accidents WHERE {_KEPT} AND Speed_limit IS NOT NULL AND Latitude IS NOT NULL AND Longitude IS NOT NULL"""
SCORED_SQL = f"SELECT Accident_Index, 1 AS has_label, 1 AS sums_to_one, 1 AS follows_scores, 1 AS confidence_is_largest {_ELIGIBLE}"


def checked_scores(scored, thresholds=None):
    """What any model's output must hold, row by row: all flags are 1."""
    p = [F.col("probability_map")[name] for name in presets.LABELS]
    margins = p if thresholds is None else [x - t for x, t in zip(p, thresholds, strict=True)]
    own = F.array_max(F.array(*[F.when(F.col("prediction") == name, m) for name, m in zip(presets.LABELS, margins, strict=True)]))
    largest = F.greatest(*margins)
    # No class over its threshold: the most probable one is taken.
    follows = own == largest if thresholds is None else F.when(largest > 0, own == largest).otherwise(own.isNotNull())
    flags = {
        "has_label": F.col("prediction").isin(*presets.LABELS),
        "sums_to_one": F.abs(sum(p[1:], p[0]) - 1.0) < 1e-9,
        "follows_scores": follows,
        "confidence_is_largest": F.col("confidence") == F.greatest(*p),
    }
    return scored.select("Accident_Index", *[F.coalesce(v, F.lit(False)).cast("int").alias(k) for k, v in flags.items()])


@query("logistic_regression", SCORED_SPEC, SCORED_SQL, ["accidents"])
def logistic_regression(d):
    rows = model_rows(d)
    return checked_scores(models.fit_logistic(rows, _LABEL, _FEATURES).transform(rows))


@query("random_forest", SCORED_SPEC, SCORED_SQL, ["accidents"])
def random_forest(d):
    rows = model_rows(d)
    return checked_scores(models.fit_forest(rows, _LABEL, _FEATURES, trees=20, depth=6).transform(rows))


def _boosted(d):
    rows = model_rows(d)
    held = fx.unit_hash(F.col("Accident_Index"), 7) < 0.2
    return rows, models.fit_boosted(rows, _LABEL, _FEATURES, iterations=500, depth=10, l2=3.0, subsample=0.8, patience=50, validation=held)


@query("boosted_trees", SCORED_SPEC, SCORED_SQL, ["accidents"])
def boosted_trees(d):
    rows, model = _boosted(d)
    return checked_scores(model.transform(rows))


@query(
    "boosted_trees_quality",
    "held_out_rows:i not_worse_than_constant:i stays_at_best_round:i within_rounds:i",
    f"SELECT count(*) AS held_out_rows, 1 AS not_worse_than_constant, 1 AS stays_at_best_round, 1 AS within_rounds {_ELIGIBLE} AND {_UNIT.replace('42:', '7:')} < 0.2e0",
    ["accidents"],
)
def boosted_trees_quality(d):
    """Log loss of the held-out rows, recomputed in SQL functions from the scored rows, against that of class shares alone."""
    rows, model = _boosted(d)
    held = fx.unit_hash(F.col("Accident_Index"), 7) < 0.2
    own = F.col("probabilities")[models.label_index(_LABEL, presets.LABELS).cast("int")]
    share = F.exp(F.element_at(F.array(*map(F.lit, model.forest.start)), models.label_index(_LABEL, presets.LABELS).cast("int") + 1))
    got = model.probabilities(rows.where(held)).agg(F.count(F.lit(1)).alias("held_out_rows"), F.avg(-F.log(own)).alias("loss"), F.avg(-F.log(share)).alias("constant"))
    best = min(model.losses)
    return got.select(
        "held_out_rows",
        (F.col("loss") <= F.col("constant") + 1e-9).cast("int").alias("not_worse_than_constant"),
        (F.abs(F.col("loss") - best) < 1e-9).cast("int").alias("stays_at_best_round"),
        F.lit(int(len(model.forest.trees) <= 500)).alias("within_rounds"),
    )


_FIRST = """WITH rows AS (SELECT Accident_Index, CASE Accident_Severity WHEN 'Fatal' THEN 0 WHEN 'Serious' THEN 1 ELSE 2 END AS y, CASE WHEN Speed_limit > 45 THEN 1 ELSE 0 END AS fast
    FROM accidents WHERE Accident_Severity IN ('Fatal', 'Serious', 'Slight') AND Speed_limit IS NOT NULL),
  shares AS (SELECT c, avg(CASE WHEN y = c THEN 1e0 ELSE 0e0 END) AS p FROM rows, (SELECT unnest([0, 1, 2]) AS c) GROUP BY c),
  leaves AS (SELECT fast, c, any_value(p) AS p, -sum(p - CASE WHEN y = c THEN 1e0 ELSE 0e0 END) / (sum(p * (1 - p)) + 3e0) AS v FROM rows, shares GROUP BY fast, c),
  scored AS (SELECT fast, c, p * exp(v) AS e FROM leaves),
  probs AS (SELECT fast, max(CASE WHEN c = 0 THEN e END) / sum(e) AS p_fatal, max(CASE WHEN c = 1 THEN e END) / sum(e) AS p_serious, max(CASE WHEN c = 2 THEN e END) / sum(e) AS p_slight
    FROM scored GROUP BY fast)
  SELECT Accident_Index, p_fatal, p_serious, p_slight FROM rows JOIN probs USING (fast)"""


@query("boosted_first_tree", "Accident_Index:i p_fatal:f p_serious:f p_slight:f", _FIRST, ["accidents"])
def boosted_first_tree(d):
    """One tree of one level on a flag: its leaf values follow from the class counts on both sides."""
    rows = d.accidents.where(F.col(_LABEL).isin(*presets.LABELS) & F.col("Speed_limit").isNotNull())
    rows = rows.select("Accident_Index", _LABEL, (F.col("Speed_limit") > 45).cast("double").alias("fast"))
    model = models.fit_boosted(rows, _LABEL, ["fast"], iterations=1, depth=1, step=1.0, l2=3.0)
    p = F.col("probabilities")
    return model.probabilities(rows).select("Accident_Index", p[0].alias("p_fatal"), p[1].alias("p_serious"), p[2].alias("p_slight"))


@query("score_batch", SCORED_SPEC, SCORED_SQL, ["accidents"])
def score_batch(d):
    rows, thresholds = model_rows(d), [0.1, 0.2, 0.5]
    return checked_scores(models.fit_logistic(rows, _LABEL, _FEATURES).transform(rows, thresholds), thresholds)


def _searched(d):
    prepared = flows.split_balance_scale(model_rows(d), _LABEL, "Accident_Index", _FEATURES, flows.Config(apply_smote=False)).rows
    train, val = (prepared.where(F.col("split") == s) for s in ("train", "val"))
    return models.hyperparameter_search(train, val, _LABEL, _FEATURES, trials=60, grid=presets.tuning_grid())


def _flagged_trials(trials, whole, params):
    """(rank, trials, flags) of trials as they come, best first; flags are 1 where order, thresholds and settings are as described."""
    rows = [r.asDict() for r in trials.collect()]  # 60 at most
    every = [r.asDict() for r in whole.collect()]
    best = max(r["macro_f1"] for r in every)
    grid = {tuple(round(float(t), 6) for t in g) for g in presets.tuning_grid()}
    out = []
    for i, r in enumerate(rows):
        own = json.loads(r["params"])
        inside = all(v in c if isinstance(c, list) else c[0] <= v <= c[1] for c, v in ((presets.BOOSTED_SPACE[k], own[k]) for k in presets.BOOSTED_SPACE))
        chosen = tuple(round(r[f"threshold_{n.lower()}"], 6) for n in presets.LABELS)
        out.append(
            (
                i + 1,
                len({x["trial"] for x in every}),
                int(i == 0 or (r["macro_f1"], -r["trial"]) < (rows[i - 1]["macro_f1"], -rows[i - 1]["trial"])),
                int((r["macro_f1"] == best) or i > 0),
                int(chosen in grid),
                int(inside and 0 <= r["trial"] < len(every)),
                int(i > 0 or all(params[k] == own[k] for k in own)),
            )
        )
    return trials.sparkSession.createDataFrame(out, "rank long, trials long, in_order long, best_is_maximum long, on_grid long, in_space long, refit_is_best long")


_TRIALS_SPEC = "rank:i trials:i in_order:i best_is_maximum:i on_grid:i in_space:i refit_is_best:i"
_TRIALS_SQL = "SELECT unnest(range(1, {})) AS rank, 60 AS trials, 1 AS in_order, 1 AS best_is_maximum, 1 AS on_grid, 1 AS in_space, 1 AS refit_is_best"


@query("saved_model", "Accident_Index:i same_as_fitted:i", f"SELECT Accident_Index, 1 AS same_as_fitted {_ELIGIBLE}", ["accidents"])
def saved_model(d):
    """Scaler, boosted trees and thresholds, saved, loaded and compared row by row with what was fitted."""
    rows = model_rows(d)
    scaler = impute.Scaler.fit(rows, _FEATURES)
    own = fitted.Fitted(models.fit_boosted(scaler.transform(rows), _LABEL, _FEATURES, iterations=20, depth=6), scaler, [0.1, 0.2, 0.5])
    path = new_path(d.spark, "fitted")
    fitted.save(d.spark, path, own)
    told = F.struct("prediction", "confidence", "probabilities")
    once = own.transform(rows).select("Accident_Index", told.alias("one"))
    again = fitted.load(d.spark, path).transform(rows).select("Accident_Index", told.alias("two"))
    return once.join(again, "Accident_Index").select("Accident_Index", F.expr("one <=> two").cast("int").alias("same_as_fitted"))


@query("hyperparameter_search", _TRIALS_SPEC, _TRIALS_SQL.format(61))
def hyperparameter_search(d):
    model, trials, _ = _searched(d)
    return _flagged_trials(trials, trials, model.params)


@query("top_trials", _TRIALS_SPEC, _TRIALS_SQL.format(11))
def top_trials(d):
    model, trials, _ = _searched(d)
    return _flagged_trials(models.top_trials(trials), trials, model.params)


@query("train_and_evaluate", "model:s base_f1:f thresholded_f1:f delta:f")
def train_and_evaluate(d):
    prepared = flows.split_balance_scale(model_rows(d), _LABEL, "Accident_Index", _FEATURES).rows
    fitters = {
        "logistic": lambda t: models.fit_logistic(t, _LABEL, _FEATURES),
        "forest": lambda t: models.fit_forest(t, _LABEL, _FEATURES, trees=200, depth=20),
    }
    return flows.train_and_evaluate(prepared, _LABEL, _FEATURES, fitters)


@query(
    "top_features",
    "feature:s",
    "SELECT feature FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, y)) AS score FROM {_COMPLETE}" for c in _STAT)
    + ") ORDER BY score DESC, feature LIMIT 2",
    ["accidents"],
)
def top_features(d):
    kept, _ = select.select_statistical(_stat_rows(d), _STAT, "y", "pearson", top_k=2)
    return d.spark.createDataFrame([(f,) for f in kept], "feature string")


@query(
    "normalise_labels",
    "Accident_Index:i label:s",
    f"SELECT Accident_Index, Accident_Severity AS label FROM accidents WHERE {_KEPT}",
    ["accidents"],
)
def normalise_labels(d):
    codes = fe.encode_target(d.accidents).withColumnRenamed(_LABEL, "label")
    return fe.normalise_labels(codes, "label")
