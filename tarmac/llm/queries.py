"""One registered query per operator, and their SQL where SQL can state the result."""

from __future__ import annotations

import hashlib
import re
import zlib

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import bpe, gam, html, lsh, maxent, mixing, order_minhash, periodic_runs, piece_bpe, simhash, spelling, token_counts, urls
from tarmac.llm.common import fold, table, text_or_empty
from tarmac.llm.neighbours_in_order import with_next


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_and_decode(texts, path, pattern).select(
        "doc_id",
        F.shiftright(F.octet_length("ids"), 2).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lsh.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.expr("id <=> component").alias("kept")
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(texts, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = maxent.score_documents(table(spark, sf_dir, "documents"), fold("doc_id", 5) == 1)
    doc_id = F.col("id").cast("long").alias("doc_id")
    return scored.select(doc_id, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _with_edits(run: list[tuple[int, str]]) -> list[tuple]:
    """Rows of op7 for all documents of a run but the last; the next in the run lends the edit."""
    out = []
    own = order_minhash.signature(run[0][1])
    for (doc_id, text), (_, following) in zip(run, run[1:], strict=False):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        changed, after = order_minhash.signature(edited), order_minhash.signature(following)
        out.append(
            (
                doc_id,
                len(text),
                hashlib.sha256(edited.encode("utf-8")).hexdigest(),
                order_minhash.to_hex(own),
                order_minhash.to_hex(changed),
                order_minhash.likeness(own, changed),
                order_minhash.likeness(own, after),
            )
        )
        own = after
    return out


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text_or_empty("text").alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(texts, _with_edits, schema)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.words_taken(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(F.col("key").cast("long").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    scored = gam.score_quality(texts, gam.train(texts, labels))
    held_out = (fold("doc_id", 5) == 0).alias("held_out")
    predicted = (F.col("score") >= gam.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", held_out, "score", predicted)


def loop_words(key: str, words: list[bytes]) -> list[bytes]:
    """A tenth of the texts, by crc32 of their id, repeat a stretch of their words to their end."""
    h, n = zlib.crc32(key.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return [*words[:start], *(words[start + i % period] for i in range(n - start))]


def _looped(key: Column, text: Column) -> Column:
    @F.pandas_udf("string")
    def loop(keys: pd.Series, texts: pd.Series) -> pd.Series:
        looped = [b" ".join(loop_words(k, t.encode("utf-8").split())).decode("utf-8") for k, t in zip(keys, texts, strict=True)]
        return pd.Series(looped, dtype=object)

    return loop(key, text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", _looped(text_or_empty("doc_id"), text_or_empty("text")).alias("text"))
    found = periodic_runs.with_runs(texts)
    best = """array_sort(runs, (a, b) -> CASE
        WHEN a.length * b.period <> b.length * a.period THEN IF(a.length * b.period > b.length * a.period, -1, 1)
        WHEN a.start <> b.start THEN IF(a.start < b.start, -1, 1) ELSE IF(a.period < b.period, -1, IF(a.period > b.period, 1, 0)) END)"""
    found = found.withColumn("best", F.try_element_at(F.expr(best), F.lit(1)))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best")["start"].alias("start"),
        F.col("best")["length"].alias("length"),
        F.col("best")["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_bpe.encode_and_decode(texts, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id",
        F.shiftright(F.octet_length("ids"), 2).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = spelling.occurrences(table(spark, sf_dir, "documents"))
    h = F.crc32(F.concat(text_or_empty("id"), F.lit(":"), "word").cast("binary"))
    at = (h % F.length("word")).cast("int")
    shorter = F.concat(F.substring("word", F.lit(1), at), F.substr("word", at + 2))
    words = seen.select(F.when(h % 31 == 0, shorter).otherwise(F.col("word")).alias("word"))
    return spelling.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_html": op2_html,
    "op3_simhash": op3_simhash,
    "op4_embeddings": op4_embeddings,
    "op5_token_counts": op5_token_counts,
    "op6_lm": op6_lm,
    "op7_fingerprints": op7_fingerprints,
    "op8_urls": op8_urls,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_runs": op11_runs,
    "op12_pieces": op12_pieces,
    "op13_spelling": op13_spelling,
}

_WORDS = "(?:^|[^0-9a-z/])({})(?:$|[^0-9a-z/])".format("|".join(re.escape(r.text) for r in urls.WORD_RULES))
_FITS = " ".join(
    f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}:{v}'"
    for h, p, v in sorted(
        ((h, "/" + p, r.verdict) for r in urls.PATH_RULES for h, p in [r.text.split("/", 1)]), key=lambda x: -len(x[0] + x[1])
    )
)

OP8_SQL = f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), judged AS (
  SELECT *, CASE {_FITS} END AS fit FROM parts
)
SELECT page_id, host, path, split_part(fit, ':', 1) AS rule,
  CASE WHEN fit IS NOT NULL THEN split_part(fit, ':', 2) WHEN regexp_matches(host, '{_WORDS}') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

#: Rows of the SQL below are summed in the order of the hash that the operator lays documents out by.
_HASH = "CAST('0x' || substr(md5('42:' || {}), 1, 15) AS BIGINT)"
OP9_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    {_HASH.format("coalesce(CAST(doc_id AS VARCHAR), '')")} AS h
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM totals
), shared AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS share
  FROM weighed
  WINDOW before AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, CASE WHEN 3 * source_size <= share * weight THEN CAST(3 * source_size AS DOUBLE)
    ELSE weight * max(share) FILTER (WHERE 3 * source_size > share * weight) OVER () END AS target
  FROM shared
), plan AS (
  SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS quota, CAST(ceil(source_size / 256) AS BIGINT) AS blocks
  FROM targets WHERE source_size > 0
), passes AS (
  SELECT *, quota // source_size AS whole, quota % source_size AS rest FROM plan
), multiplied AS (
  SELECT *, [x FOR x IN range(CAST(h % blocks + 1 AS BIGINT), CAST(h % blocks + 202 AS BIGINT)) IF gcd(x, blocks) = 1][1] AS a
  FROM (SELECT *, {_HASH.format("whole || ':' || coalesce('=' || source, '')")} AS h FROM passes)
), partial AS (
  SELECT source, (CAST(a AS HUGEINT) * (j + 1) - 1) % blocks AS block, least(256, rest - 256 * j) AS words
  FROM (SELECT *, unnest(range(CAST(ceil(rest / 256) AS BIGINT))) AS j FROM multiplied)
), laid AS (
  SELECT doc_id, source, size, h,
    CAST(sum(size) OVER (PARTITION BY source ORDER BY h, CAST(doc_id AS VARCHAR), size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
  FROM sized WHERE size > 0
), pieces AS (
  SELECT *, unnest(range(start // 256, (start + size - 1) // 256 + 1)) AS block FROM laid
), parts AS (
  SELECT l.source, l.start, sum(greatest(0, least(l.block * 256 + p.words, l.start + l.size) - greatest(l.block * 256, l.start))) AS taken
  FROM pieces l JOIN partial p ON l.source IS NOT DISTINCT FROM p.source AND l.block = p.block GROUP BY l.source, l.start
), taken AS (
  SELECT l.doc_id, l.source, l.size, coalesce(p.taken, 0) AS taken
  FROM laid l LEFT JOIN parts p ON l.source IS NOT DISTINCT FROM p.source AND l.start = p.start
  UNION ALL SELECT doc_id, source, size, 0 FROM sized WHERE size = 0
)
SELECT t.doc_id, CAST(t.size AS BIGINT) AS size, p.source_size, p.target,
  CAST(t.taken + t.size * coalesce(w.whole, 0) AS BIGINT) AS taken
FROM taken t JOIN targets p ON t.source IS NOT DISTINCT FROM p.source
LEFT JOIN passes w ON t.source IS NOT DISTINCT FROM w.source
"""

ORACLES: dict[str, str] = {"op8_urls": OP8_SQL, "op9_mixing": OP9_SQL}
