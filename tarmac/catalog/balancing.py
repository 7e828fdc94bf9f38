"""Splits, sampling, class weights, nearest neighbours, SMOTE and Tomek links."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.catalog.registry import query
from tarmac.operators import balance, neighbours
from tarmac.schema import col


def _hash(text: str, seed: int = 42) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {text}), 1, 15) AS BIGINT)"


def _ranked(by: str, key: str = "CAST(Accident_Index AS STRING)", table: str = "accidents") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return (
        f"(SELECT *, row_number() OVER ({part} ORDER BY h) AS rn, count(*) OVER ({part}) AS n "
        f"FROM (SELECT *, {_hash(key)} AS h FROM {table}))"
    )


@query(
    "stratified_split",
    "Accident_Index:i Accident_Severity:s split:s",
    f"""SELECT Accident_Index, Accident_Severity, CASE WHEN rn <= floor(n * 0.2e0 + 0.5e0) THEN 'test'
          WHEN rn <= floor(n * (0.2e0 + 0.4e0) + 0.5e0) THEN 'val' ELSE 'train' END AS split FROM {_ranked('Accident_Severity')}""",
    ["accidents"],
)
def stratified_split(d):
    return balance.train_val_test(d.accidents, "Accident_Severity", "Accident_Index")


@query(
    "stratified_split_80_20",
    "doc_id:i toxic:i split:s",
    f"""SELECT doc_id, toxic, CASE WHEN rn <= floor(n * 0.2e0 + 0.5e0) THEN 'val' ELSE 'train' END AS split
        FROM {_ranked('toxic', 'CAST(doc_id AS STRING)', 'labels')}""",
)
def stratified_split_80_20(d):
    return balance.stratified_split(d.labels, "toxic", "doc_id", {"val": 0.2, "train": 0.8})


@query(
    "unstratified_split",
    "event_id:i split:s",
    f"""SELECT event_id, CASE WHEN rn <= floor(n * 0.2e0 + 0.5e0) THEN 'test' WHEN rn <= floor(n * (0.2e0 + 0.2e0) + 0.5e0) THEN 'val' ELSE 'train' END AS split
        FROM {_ranked('', 'CAST(event_id AS STRING)', 'events')}""",
)
def unstratified_split(d):
    return balance.stratified_split(d.events, None, "event_id", {"test": 0.2, "val": 0.2, "train": 0.6})


@query(
    "class_weights",
    "label:s n:i weight:f",
    """SELECT Accident_Severity AS label, count(*) AS n, (SELECT count(*) FROM accidents) / CAST((SELECT count(DISTINCT Accident_Severity) FROM accidents) * count(*) AS DOUBLE) AS weight
       FROM accidents GROUP BY Accident_Severity""",
    ["accidents"],
)
def class_weights(d):
    return balance.class_weights(d.accidents, "Accident_Severity")


@query(
    "undersample_to",
    "Accident_Index:i Accident_Severity:s",
    f"""SELECT Accident_Index, Accident_Severity FROM {_ranked('Accident_Severity')}
        WHERE rn <= CASE Accident_Severity WHEN 'Slight' THEN 400 WHEN 'Serious' THEN 100 ELSE n END""",
    ["accidents"],
)
def undersample_to(d):
    return balance.undersample_to(d.accidents, "Accident_Severity", "Accident_Index", {"Slight": 400, "Serious": 100})


_V = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_WITHIN = f"""SELECT a.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, b.v), 12), b.vec_id) AS rank, b.vec_id AS neighbour,
    list_distance(a.v, b.v) AS distance FROM {_V} AS a JOIN {_V} AS b ON a.label = b.label AND a.vec_id <> b.vec_id"""


@query("knn_within_class", "vec_id:i rank:i neighbour:i distance:f", f"SELECT * FROM ({_WITHIN}) WHERE rank <= 5")
def knn_within_class(d):
    return neighbours.knn(d.embeddings, "vec_id", "embedding", 5, within="label")


@query("knn_within_class_many_chunks", "vec_id:i rank:i neighbour:i distance:f", f"SELECT * FROM ({_WITHIN}) WHERE rank <= 3")
def knn_within_class_many_chunks(d):
    # Small chunks force pivots, pruning and visits at test scale.
    return neighbours.knn(d.embeddings, "vec_id", "embedding", 3, within="label", chunk_rows=24, visitors=64)


_FEATURES = [f"f{i}" for i in range(64)]
_PICK = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(64))
_LIST = "[" + ", ".join(_FEATURES) + "]"


def embedding_features(d, width: int = 64):
    return d.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(width)])


def _smote_sql(target: str) -> str:
    values = ", ".join(f"b.{f} + gap * (o.{f} - b.{f}) AS {f}" for f in _FEATURES)
    return f"""WITH e AS (SELECT vec_id, label, {_PICK} FROM embeddings),
      c AS (SELECT label, count(*) AS n, {target} - count(*) AS lack FROM e GROUP BY label),
      base AS (SELECT e.*, n, lack, row_number() OVER (PARTITION BY e.label ORDER BY {_hash('CAST(vec_id AS STRING)')}) AS rn FROM e JOIN c USING (label)),
      drawn AS (SELECT *, vec_id || ':' || copy AS draw FROM (
        SELECT *, unnest(range(1, lack // n + CASE WHEN rn <= lack % n THEN 2 ELSE 1 END)) AS copy FROM base WHERE lack > 0)),
      near AS (SELECT a.vec_id, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY
          round(list_distance({_LIST.replace('f', 'a.f')}, {_LIST.replace('f', 'b.f')}), 12), b.vec_id) AS rank
        FROM e AS a JOIN e AS b ON a.label = b.label AND a.vec_id <> b.vec_id),
      chosen AS (SELECT *, {_hash('draw', 43)} % least(5, n - 1) + 1 AS rank, {_hash('draw', 44)} / 1152921504606846976e0 AS gap FROM drawn)
      SELECT CAST(vec_id AS STRING) AS vec_id, label, {', '.join(_FEATURES)}, 0 AS is_synthetic FROM e
      UNION ALL SELECT 'synthetic:' || draw, b.label, {values}, 1 FROM chosen AS b JOIN near USING (vec_id, rank) JOIN e AS o ON o.vec_id = neighbour"""


_SMOTE_SPEC = "vec_id:s label:i " + " ".join(f"{f}:f" for f in _FEATURES) + " is_synthetic:i"


@query("smote_not_majority", _SMOTE_SPEC, _smote_sql("(SELECT max(k) FROM (SELECT count(*) AS k FROM e GROUP BY label))"))
def smote_not_majority(d):
    return balance.smote(embedding_features(d), "label", "vec_id", _FEATURES)


@query("smote_to_targets", _SMOTE_SPEC, _smote_sql("CASE label WHEN 1 THEN 600 WHEN 5 THEN 500 ELSE 0 END"))
def smote_to_targets(d):
    return balance.smote(embedding_features(d), "label", "vec_id", _FEATURES, {1: 600, 5: 500})


_LINKS = f"""WITH e AS (SELECT vec_id, label, {_PICK} FROM embeddings),
  near AS (SELECT a, la, b, lb FROM (SELECT a.vec_id AS a, a.label AS la, b.vec_id AS b, b.label AS lb, row_number() OVER (PARTITION BY a.vec_id ORDER BY
      round(list_distance({_LIST.replace('f', 'a.f')}, {_LIST.replace('f', 'b.f')}), 12), b.vec_id) AS rank FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id) WHERE rank = 1),
  links AS (SELECT x.a AS left_key, x.b AS right_key FROM near AS x JOIN near AS y ON x.a = y.b AND x.b = y.a WHERE x.la <> x.lb AND x.a < x.b)"""


@query("tomek_links", "left_key:i right_key:i", f"{_LINKS} SELECT * FROM links")
def tomek_links(d):
    return balance.tomek_links(embedding_features(d), "label", "vec_id", _FEATURES)


@query(
    "remove_tomek_links",
    "vec_id:i label:i",
    f"{_LINKS} SELECT vec_id, label FROM e WHERE vec_id NOT IN (SELECT left_key FROM links) AND vec_id NOT IN (SELECT right_key FROM links)",
)
def remove_tomek_links(d):
    return balance.remove_tomek_links(embedding_features(d), "label", "vec_id", _FEATURES)


_OWN = "[" + ", ".join(f"a.{f}" for f in _FEATURES) + "]"
_OTHER = "[" + ", ".join(f"b.{f}" for f in _FEATURES) + "]"
_GROWN = _smote_sql("(SELECT max(k) FROM (SELECT count(*) AS k FROM e GROUP BY label))")


@query(
    "smote_tomek",
    "label:i is_synthetic:i n:i",
    f"""WITH grown AS MATERIALIZED ({_GROWN}),
      nearest AS (SELECT a.vec_id AS a, a.label AS la, b.vec_id AS b, b.label AS lb,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance({_OWN}, {_OTHER}), 12), b.vec_id) AS rank
        FROM grown AS a JOIN grown AS b ON a.vec_id <> b.vec_id),
      first AS (SELECT * FROM nearest WHERE rank = 1),
      links AS (SELECT x.a FROM first AS x JOIN first AS y ON x.a = y.b AND x.b = y.a WHERE x.la <> x.lb)
      SELECT label, is_synthetic, count(*) AS n FROM grown WHERE vec_id NOT IN (SELECT a FROM links) GROUP BY 1, 2""",
)
def smote_tomek(d):
    out = balance.smote_tomek(embedding_features(d), "label", "vec_id", _FEATURES)
    return out.groupBy(col("label"), "is_synthetic").agg(F.count(F.lit(1)).alias("n"))
