"""Classifiers with one contract: label texts in, label texts and ordered probabilities out."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac import presets
from tarmac.functions import scalar as fx
from tarmac.operators import balance, boosting, deepforest, select, tuning
from tarmac.schema import col
from tarmac.session import cut_lineage

#: Rows down to which a task of a deep forest is worth a core of its own, and the depth from which a forest is deep.
DEEP_ROWS_PER_TASK, DEEP = 25_000, 10


@dataclass
class Scored:
    """A fitted model: ``transform`` adds prediction, probabilities, probability map, confidence."""

    labels: list[str]
    stages: list[PipelineModel]
    params: dict = field(default_factory=dict)

    def probabilities(self, df: DataFrame) -> DataFrame:
        """Add ``probabilities``, one double per label in the fixed order."""
        out = df
        for stage in self.stages:
            out = stage.transform(out)
        return out.withColumn("probabilities", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")

    def transform(self, df: DataFrame, thresholds: Sequence[float] | None = None) -> DataFrame:
        out = self.probabilities(df)
        p = F.col("probabilities")
        index = (
            fx.argmax([p[i] for i in range(len(self.labels))]) if thresholds is None else fx.chosen_index(p, thresholds)
        )
        return out.withColumns(
            {
                "prediction": fx.pick_label(index, self.labels),
                "probability_map": fx.probability_map(p, self.labels),
                "confidence": F.array_max(p),
            }
        )


def label_index(label: Column | str, labels: Sequence[str]) -> Column:
    return fx.lookup(label, {name: float(i) for i, name in enumerate(labels)})


def _training(df: DataFrame, label: str, labels: Sequence[str], weights: Mapping[str, float] | None, require_all: bool) -> tuple[DataFrame, int]:
    counts = balance.class_counts(df, label)
    unknown = set(counts) - set(labels)
    if unknown:
        raise ValueError(f"unexpected labels {sorted(map(str, unknown))}, expected {list(labels)}")
    if require_all and set(labels) - set(counts):
        raise ValueError(f"classes missing from the training rows: {sorted(set(labels) - set(counts))}")
    out = df.withColumn("_y", label_index(label, labels)).where(F.col("_y").isNotNull())
    weight = fx.lookup(label, weights, 1.0) if weights else F.lit(1.0)
    return out.withColumn("_w", weight), sum(counts.values())


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features")


def fit_logistic(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    labels: Sequence[str] = presets.LABELS,
    c: float = 0.1,
    max_iter: int = 2_000,
    weights: Mapping[str, float] | None = None,
    require_all: bool = False,
) -> Scored:
    """Multinomial logistic regression; ``c`` is the inverse penalty, so regParam = 1 / (c · rows)."""
    rows, n = _training(df, label, labels, weights, require_all)
    lr = LogisticRegression(
        featuresCol="features", labelCol="_y", weightCol="_w", family="multinomial", regParam=1.0 / (c * max(n, 1)), maxIter=max_iter
    )
    model = Pipeline(stages=[_assembler(features), lr]).fit(_with_all_classes(rows, labels, features))
    return Scored(list(labels), [model])


def _forest_rows(rows: DataFrame, n: int, depth: int) -> DataFrame:
    """The rows a forest passes over; for a deep one, in up to a task per core where a partition holds more than a task's rows."""
    per_task = select.ROWS_PER_TASK
    if depth > DEEP:
        per_task = min(per_task, max(DEEP_ROWS_PER_TASK, -(-n // rows.sparkSession.sparkContext.defaultParallelism)))
    return select._spread(rows, per_task)


@dataclass
class Deep(Scored):
    """A fitted forest whose trees were grown whole, a task each."""

    forest: deepforest.DeepForest | None = None
    features: list[str] = field(default_factory=list)

    def probabilities(self, df: DataFrame) -> DataFrame:
        return self.forest.with_probabilities(df, self.features)


def fit_forest(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    labels: Sequence[str] = presets.LABELS,
    trees: int = 200,
    depth: int = 20,
    min_leaf: int = 2,
    weights: Mapping[str, float] | None = None,
    require_all: bool = False,
    seed: int = 42,
) -> Scored:
    """Random forest. Rows are spread where few partitions hold many, which changes the draws there.

    A deep forest on more than ``DEEP_ROWS_PER_TASK`` rows, up to as many as a task holds, grows its trees whole, a task each; a larger
    table is passed over level by level. Below, it keeps every row's node per tree between passes; its trees are the same.
    """
    rows, n = _training(df, label, labels, weights, require_all)
    if depth > DEEP and DEEP_ROWS_PER_TASK < n <= deepforest.MAX_ROWS:
        by_class = [float((weights or {}).get(name, 1.0)) for name in labels]
        forest = deepforest.fit(rows.select("_y", *[col(f) for f in features]), features, by_class, trees, min(depth, 30), min_leaf, seed)
        return Deep(list(labels), [], forest=forest, features=list(features))
    rows = _forest_rows(rows, n, depth)
    rf = RandomForestClassifier(
        featuresCol="features", labelCol="_y", weightCol="_w", numTrees=trees, maxDepth=min(depth, 30), minInstancesPerNode=min_leaf, seed=seed,
        cacheNodeIds=depth > DEEP,
    )
    model = Pipeline(stages=[_assembler(features), rf]).fit(_with_all_classes(rows, labels, features))
    return Scored(list(labels), [model])


@dataclass
class Boosted(Scored):
    """A fitted model of boosted trees."""

    forest: boosting.Forest | None = None
    features: list[str] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def probabilities(self, df: DataFrame) -> DataFrame:
        return boosting.with_probabilities(df, self.forest, self.features)


def fit_boosted(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    labels: Sequence[str] = presets.LABELS,
    validation: Column | None = None,
    weights: Mapping[str, float] | None = None,
    require_all: bool = False,
    **settings,
) -> Boosted:
    """Boosted trees for all classes at once, with a softmax loss and a penalty on leaf values.

    ``settings`` are those of ``boosting.Settings``: iterations, depth, step, l2, min_leaf, subsample, feature_share, min_gain,
    patience, seed. Rows that ``validation`` marks are not trained on: growing stops when their
    loss has not fallen for ``patience`` rounds, and the trees up to the best round stay.
    """
    rows, _ = _training(df, label, labels, weights, require_all)
    held = F.lit(False) if validation is None else F.coalesce(validation, F.lit(False))
    rows = cut_lineage(rows.select("_y", "_w", held.alias("_held"), *[col(f) for f in features]))
    forest, losses = boosting.fit(rows, features, len(labels), boosting.Settings(**settings))
    return Boosted(list(labels), [], params=dict(settings), forest=forest, features=list(features), losses=losses)


def _with_all_classes(rows: DataFrame, labels: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Declare the class count on the label column, so absent classes keep their place."""
    attr = {"ml_attr": {"type": "nominal", "name": "_y", "vals": list(labels)}}
    return rows.withColumn("_y", F.col("_y").alias("_y", metadata=attr))


def baseline(
    train: DataFrame,
    df: DataFrame,
    label: str,
    key: str,
    strategy: str = "most_frequent",
    constant: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """Predictions that ignore the features: constant, most_frequent, stratified or uniform."""
    if strategy == "constant":
        if constant is None:
            raise ValueError("'constant' must be set when strategy='constant'")
        return df.withColumn("prediction", F.lit(constant))
    counts = balance.class_counts(train, label)
    names = sorted(counts)
    if strategy == "most_frequent":
        return df.withColumn("prediction", F.lit(min(names, key=lambda c: (-counts[c], c))))
    if strategy not in ("stratified", "uniform"):
        raise ValueError(f"unknown strategy {strategy!r}")
    total = sum(counts.values())
    draw = fx.unit_hash(col(key), seed)
    upto, chosen = 0.0, None
    for name in names[:-1]:
        upto += counts[name] / total if strategy == "stratified" else 1.0 / len(names)
        chosen = F.when(draw < upto, name) if chosen is None else chosen.when(draw < upto, name)
    return df.withColumn("prediction", F.lit(names[-1]) if chosen is None else chosen.otherwise(names[-1]))


def hyperparameter_search(
    train: DataFrame,
    val: DataFrame,
    label: str,
    features: Sequence[str],
    space: Mapping = presets.BOOSTED_SPACE,
    trials: int = 60,
    seed: int = 42,
    grid=None,
    labels: Sequence[str] = presets.LABELS,
    overrides: Mapping | None = None,
    **options,
) -> tuple[Boosted, DataFrame, list[float]]:
    """Adaptive search for the best thresholded macro F1 on ``val``; refit on train ∪ val.

    Trials stop early by their loss on ``val`` or at a rung (see ``tuning``); the refit grows as many
    trees as the best trial kept. Returns the refitted model, a table of trials (best first) and the best
    thresholds. ``overrides`` fixes single parameters; ``options`` go to ``tuning.search``.
    """
    grid = presets.tuning_grid() if grid is None else grid
    both = train.withColumn("_held", F.lit(False)).unionByName(val.withColumn("_held", F.lit(True)), allowMissingColumns=True)
    rows, _ = _training(both, label, labels, None, False)
    rows = cut_lineage(rows.select(col(label), "_y", "_held", *[col(f) for f in features]))
    done = tuning.search(rows, features, labels, space, grid, trials, seed=seed, overrides=overrides, **options)
    best = done[0]
    table = train.sparkSession.createDataFrame(
        [(t["trial"], t["macro_f1"], *t["thresholds"], t["trees"], json.dumps(t["params"], sort_keys=True)) for t in done],
        "trial int, macro_f1 double, " + ", ".join(f"threshold_{n.lower()} double" for n in labels) + ", trees int, params string",
    )
    settings, weights = tuning.settings_of({**best["params"], "iterations": best["trees"]}, labels, seed)
    model = fit_boosted(rows, label, features, labels, weights=dict(zip(labels, weights.tolist(), strict=True)), **asdict(settings))
    model.params.update(best["params"])
    return model, table, best["thresholds"]


def top_trials(trials: DataFrame, n: int = 10) -> DataFrame:
    return trials.orderBy(F.desc("macro_f1"), "trial").limit(n)
