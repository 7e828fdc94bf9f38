"""URL filters: pattern rules indexed by their rarest literal token.

Every rule's pattern names literal tokens that a matching URL must hold. The rarest of them, by
counts over all URLs, is the rule's entry in the index. A URL's own tokens fetch its candidate
rules by a join, and only those run their regular expressions. All steps are DataFrame operations.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import named

#: Rules whose index may be broadcast, at most; a larger list is joined on shuffled tokens.
BROADCAST_RULES = 50_000
_SEPARATORS = "[^0-9a-z]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on host and path as one text, in lower case if ``any_case``.

    ``tokens`` are literals that a match needs as whole tokens. Rules that are reported by ``name``
    come before the others; among either, the longer ``text`` wins, then block before allow.
    """

    text: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    name: bool = True
    any_case: bool = False


def literal_tokens(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(t for t in re.split(_SEPARATORS, text.lower()) if t))


def path_rule(text: str, verdict: str) -> Rule:
    """A rule ``host/path``: the host and all its subdomains, for paths that start with the path."""
    host = text.split("/", 1)[0]
    # The last token of the path may go on in the URL, so only tokens that end inside it count.
    ended = text if re.search(r"[^0-9A-Za-z]$", text) else re.sub(r"[0-9A-Za-z]+$", "", text)
    return Rule(text, verdict, rf"^(?:[^/]*\.)?{re.escape(text)}", literal_tokens(ended) or literal_tokens(host))


def word_rule(word: str, verdict: str = "block") -> Rule:
    """A rule of the method itself: a word or hyphenated words as whole tokens of the host."""
    return Rule(word, verdict, rf"^(?:[^/]*[^0-9a-z/])?{re.escape(word)}(?![0-9a-z])[^/]*/?", literal_tokens(word), name=False, any_case=True)


#: Rules of the contract.
PATH_RULES = (
    path_rule("net/", "block"),
    path_rule("example.net/en/", "allow"),
    path_rule("example.com/de/", "block"),
    path_rule("org/fr/", "allow"),
)
#: The method's own rules for hosts that no path rule covers.
WORD_RULES = tuple(map(word_rule, ("adult", "ads-track", "casino", "cheap-pills", "free-bets", "spam-farm", "viagra", "xxx")))
DEFAULT_VERDICT = "allow"


def with_parts(df: DataFrame, url_col: str, host_col: str, path_col: str) -> DataFrame:
    """Add host (A-Z in lower case) and path; both are empty for a null or a text without ``://``."""
    url = F.coalesce(named(url_col).cast("string"), F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumns({host_col: lower, path_col: path})


def _tokens(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), _SEPARATORS)), "")


def index_rules(places: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(token, rule_no): each rule under the literal that the fewest rows of ``places`` hold."""
    spark = places.sparkSession
    literals = spark.createDataFrame(
        [(t, n, at) for n, rule in enumerate(rules) for at, t in enumerate(rule.tokens)], "token string, rule_no int, at int"
    )
    wanted = literals.select("token").distinct()
    wanted = F.broadcast(wanted) if len(rules) <= BROADCAST_RULES else wanted
    held = places.select(F.explode(_tokens(F.col("place"))).alias("token")).join(wanted, "token", "left_semi")
    counts = held.groupBy("token").agg(F.count("*").alias("n"))
    ranked = literals.join(counts, "token", "left").groupBy("rule_no")
    return ranked.agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "at")).alias("token"))


def judge_urls(
    df: DataFrame,
    rules: Sequence[Rule] = PATH_RULES + WORD_RULES,
    url_col: str = "url",
    default: str = DEFAULT_VERDICT,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (the text of the path rule that decides, else null) and ``verdict``.

    A null URL or one without ``://`` has an empty host and path, fits no rule and gets the
    default. Equal URLs get equal verdicts, so rows may repeat. Columns that have these names
    already are replaced. Empty tables stay empty; without rules all verdicts are the default.
    """
    parts = with_parts(df, url_col, "host", "path")
    if not rules:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    places = parts.select(F.concat("host", "path").alias("place"))
    table = df.sparkSession.createDataFrame(
        [(n, r.text, r.verdict, r.pattern, r.name, r.any_case) for n, r in enumerate(rules)],
        "rule_no int, text string, verdict string, pattern string, is_named boolean, any_case boolean",
    )
    index = index_rules(places, rules).join(table, "rule_no")
    index = F.broadcast(index) if len(rules) <= BROADCAST_RULES else index
    candidates = places.select("place", F.explode(_tokens(F.col("place"))).alias("token")).join(index, "token")
    subject = F.when(F.col("any_case"), F.lower("place")).otherwise(F.col("place"))
    hits = candidates.where(F.regexp_like(subject, F.col("pattern")))
    rank = F.struct("is_named", F.length("text"), F.col("verdict") == "block", "text", "verdict")
    decided = hits.groupBy("place").agg(F.max(rank).alias("best"))
    decided = decided.select(F.col("place").alias("_place"), F.col("best.is_named").alias("_named"), F.col("best.text").alias("_rule"), F.col("best.verdict").alias("_verdict"))
    judged = parts.join(decided, F.concat("host", "path") == F.col("_place"), "left")
    return judged.withColumns(
        {"rule": F.when(F.col("_named"), F.col("_rule")), "verdict": F.coalesce("_verdict", F.lit(default))}
    ).drop("_place", "_named", "_rule", "_verdict")
