"""Metrics, thresholds and diagnostics over a table of labels and class probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac import presets
from tarmac.catalog.registry import query
from tarmac.functions import scalar as fx
from tarmac.operators import evaluate

_P = ["p_fatal", "p_serious", "p_slight"]
_ARGMAX = """CASE WHEN p_fatal >= p_serious AND p_fatal >= p_slight THEN 'Fatal' WHEN p_serious >= p_slight THEN 'Serious' ELSE 'Slight' END"""


def _margin(a, b, c):
    m = [f"(p_fatal - {a})", f"(p_serious - {b})", f"(p_slight - {c})"]
    return (
        f"CASE WHEN greatest({', '.join(m)}) > 0 THEN CASE WHEN {m[0]} >= {m[1]} AND {m[0]} >= {m[2]} THEN 'Fatal' "
        f"WHEN {m[1]} >= {m[2]} THEN 'Serious' ELSE 'Slight' END ELSE {_ARGMAX} END"
    )


_SCORED = f"(SELECT *, {_ARGMAX} AS prediction FROM scores)"


def scored(d):
    p = F.array(*_P)
    return d.scores.withColumn("prediction", fx.pick_label(fx.argmax([p[i] for i in range(3)]), presets.LABELS))


@query(
    "confusion_matrix",
    "label:s position:i Fatal:i Serious:i Slight:i",
    f"""SELECT label, list_position(['Fatal', 'Serious', 'Slight'], label) - 1 AS position, count(*) FILTER (WHERE prediction = 'Fatal') AS Fatal,
          count(*) FILTER (WHERE prediction = 'Serious') AS Serious, count(*) FILTER (WHERE prediction = 'Slight') AS Slight FROM {_SCORED} GROUP BY label""",
    ["scores"],
)
def confusion_matrix(d):
    return evaluate.confusion_matrix(scored(d))


_CLASS = f"""(SELECT c AS class, coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0) AS recall,
    coalesce(2e0 * tp / nullif(support + predicted, 0), 0) AS f1, support FROM (
    SELECT c, (SELECT count(*) FROM s WHERE label = c AND prediction = c) AS tp, (SELECT count(*) FROM s WHERE label = c) AS support,
      (SELECT count(*) FROM s WHERE prediction = c) AS predicted FROM (SELECT unnest(['Fatal', 'Serious', 'Slight']) AS c)))"""
REPORT_SQL = f"""WITH s AS {_SCORED}, k AS {_CLASS}
  SELECT * FROM k UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT count(*) FILTER (WHERE label = prediction) / CAST(count(*) AS DOUBLE) AS a, count(*) AS n FROM s)
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM k
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM k"""


@query("classification_report", "class:s precision:f recall:f f1:f support:i", REPORT_SQL, ["scores"])
def classification_report(d):
    return evaluate.classification_report(scored(d))


_COST = "CASE label || '|' || prediction WHEN 'Fatal|Serious' THEN 20 WHEN 'Fatal|Slight' THEN 100 WHEN 'Serious|Fatal' THEN 5 WHEN 'Serious|Slight' THEN 15 WHEN 'Slight|Fatal' THEN 2 WHEN 'Slight|Serious' THEN 1 ELSE 0 END"
BUSINESS_SQL = f"""SELECT avg(CASE WHEN label = 'Fatal' THEN CASE WHEN prediction = 'Fatal' THEN 1e0 ELSE 0e0 END END) AS fatal_recall,
    avg(CASE WHEN label = 'Serious' THEN CASE WHEN prediction = 'Serious' THEN 1e0 ELSE 0e0 END END) AS serious_recall,
    avg(CASE WHEN label <> 'Slight' THEN CASE WHEN prediction <> 'Slight' THEN 1e0 ELSE 0e0 END END) AS critical_case_recall,
    avg(CASE WHEN label <> 'Slight' THEN CASE WHEN prediction = 'Slight' THEN 1e0 ELSE 0e0 END END) AS critical_undertriage_rate,
    avg({_COST}) AS weighted_cost FROM {_SCORED}"""


@query(
    "business_metrics",
    "fatal_recall:f serious_recall:f critical_case_recall:f critical_undertriage_rate:f weighted_cost:f",
    BUSINESS_SQL,
    ["scores"],
)
def business_metrics(d):
    return evaluate.business_metrics(scored(d))


@query(
    "probability_diagnostics",
    "class:s mean:f p95:f max:f frequency:f has_signal:i",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS class, avg({p}) AS mean, quantile_cont({p}, 0.95) AS p95, max({p}) AS max, avg(CASE WHEN label = '{c}' THEN 1e0 ELSE 0e0 END) AS frequency,
              CASE WHEN abs(avg({p}) - avg(CASE WHEN label = '{c}' THEN 1e0 ELSE 0e0 END)) > 0.01e0 THEN 1 ELSE 0 END AS has_signal FROM scores"""
        for c, p in zip(presets.LABELS, _P)
    ),
    ["scores"],
)
def probability_diagnostics(d):
    return evaluate.probability_diagnostics(d.scores, "label", _P)


@query(
    "predict_with_thresholds",
    "row_id:i prediction:s",
    f"SELECT row_id, {_margin('0.12e0', '0.3e0', '0.5e0')} AS prediction FROM scores",
    ["scores"],
)
def predict_with_thresholds(d):
    return evaluate.predict_with_thresholds(d.scores, F.array(*_P), [0.12, 0.3, 0.5])


def _search_sql(grid):
    values = ", ".join(f"({i}, {a!r}e0, {b!r}e0, {c!r}e0)" for i, (a, b, c) in enumerate(grid))
    return f"""WITH g(combo, ta, tb, tc) AS (VALUES {values}),
      n AS (SELECT combo, label, {_margin('ta', 'tb', 'tc')} AS prediction, count(*) AS n FROM scores, g GROUP BY 1, 2, 3),
      k AS (SELECT combo, class, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (
        SELECT combo, label AS class, CASE WHEN label = prediction THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM n
        UNION ALL SELECT combo, prediction, 0, 0, n FROM n) GROUP BY combo, class),
      f AS (SELECT combo, avg(2e0 * tp / (support + predicted)) AS macro_f1 FROM k GROUP BY combo)
      SELECT ta AS threshold_fatal, tb AS threshold_serious, tc AS threshold_slight, macro_f1 FROM f JOIN g USING (combo) ORDER BY round(macro_f1, 12) DESC, combo LIMIT 1"""


_SEARCH_SPEC = "threshold_fatal:f threshold_serious:f threshold_slight:f macro_f1:f"


@query("threshold_search", _SEARCH_SPEC, _search_sql(presets.training_grid()), ["scores"])
def threshold_search(d):
    return evaluate.threshold_search(d.scores, "label", _P)


@query("threshold_search_tuning_grid", _SEARCH_SPEC, _search_sql(presets.tuning_grid()), ["scores"])
def threshold_search_tuning_grid(d):
    return evaluate.threshold_search(d.scores, "label", _P, presets.tuning_grid())


@query(
    "evaluate",
    "section:s name:s metric:s value:f",
    f"""SELECT 'report' AS section, class AS name, metric, value FROM (UNPIVOT (SELECT class, precision, recall, f1, CAST(support AS DOUBLE) AS support FROM ({REPORT_SQL}))
          ON precision, recall, f1, support INTO NAME metric VALUE value)
        UNION ALL SELECT 'business', 'all', metric, value FROM (UNPIVOT ({BUSINESS_SQL})
          ON fatal_recall, serious_recall, critical_case_recall, critical_undertriage_rate, weighted_cost INTO NAME metric VALUE value)""",
    ["scores"],
)
def evaluate_all(d):
    return evaluate.evaluate(scored(d))


@query(
    "summary_metrics",
    "accuracy:f macro_f1:f weighted_f1:f",
    f"""WITH s AS {_SCORED}, k AS {_CLASS} SELECT (SELECT avg(CASE WHEN label = prediction THEN 1e0 ELSE 0e0 END) FROM s) AS accuracy,
          avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM k""",
    ["scores"],
)
def summary_metrics(d):
    return evaluate.summary_metrics(evaluate.pair_counts(scored(d)))


_TWO_RUNS = f"""(SELECT run, label, CASE run WHEN 'a' THEN {_ARGMAX} ELSE {_margin('0.3e0', '0.3e0', '0.3e0')} END AS base,
  {_margin('0.12e0', '0.3e0', '0.5e0')} AS tuned FROM scores, (SELECT unnest(['a', 'b']) AS run))"""


def _run_f1(column):
    return f"""(SELECT run, avg(2e0 * tp / (support + predicted)) AS f1 FROM (SELECT run, class, sum(tp) AS tp, sum(s) AS support, sum(p) AS predicted FROM (
      SELECT run, label AS class, CASE WHEN label = {column} THEN 1 ELSE 0 END AS tp, 1 AS s, 0 AS p FROM {_TWO_RUNS}
      UNION ALL SELECT run, {column}, 0, 0, 1 FROM {_TWO_RUNS}) GROUP BY run, class) GROUP BY run)"""


@query(
    "compare_runs",
    "run:s base_f1:f thresholded_f1:f delta:f",
    f"SELECT run, x.f1 AS base_f1, y.f1 AS thresholded_f1, y.f1 - x.f1 AS delta FROM {_run_f1('base')} AS x JOIN {_run_f1('tuned')} AS y USING (run)",
    ["scores"],
)
def compare_runs(d):
    p = F.array(*_P)
    first = scored(d).withColumn("run", F.lit("a")).withColumnRenamed("prediction", "base")
    second = evaluate.predict_with_thresholds(d.scores, p, [0.3, 0.3, 0.3], target="base").withColumn("run", F.lit("b"))
    both = first.unionByName(second)
    both = evaluate.predict_with_thresholds(both, p, [0.12, 0.3, 0.5], target="tuned")
    return evaluate.compare_runs(both, "run", "label", "base", "tuned")
