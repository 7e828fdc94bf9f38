"""Mixing sources to target weights, block by block.

The words of a source are one stream, its documents in pseudorandom order, packed into blocks of
fixed length. A source's target says how many blocks are drawn from it: whole passes over its
stream, then part of one. The draws fall on output shards at random, so the source counts of a
shard are multinomial given the totals; drawing them apart from the totals would leave each
source off its target by the square root of its draws. The draws of a source are numbered through the
shards in turn, a pseudorandom permutation per source and pass maps numbers to block indices, and
blocks are joined by index. The last draw of a source takes the words that are left only.

All steps are DataFrame operations. Documents are spread by hash, not by source, so a source with
most of the rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.scalar import HASH_RANGE, stable_hash
from tarmac.llm.common import WORD, named, scratch_name
from tarmac.session import cut_lineage

BLOCK_WORDS = 256
SHARD_BLOCKS = 1024
MAX_PASSES = 3
SEED = 42
#: Rows of a bucket in which documents are ordered, about.
BUCKET_ROWS = 4000
#: Draws that one row unfolds to, at most.
CHUNK = 4096
#: Among so many whole numbers in a row one at least is coprime to any 64-bit number.
COPRIME_SPAN = 200


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _number(key: Column, seed: int) -> Column:
    return stable_hash(key, seed)


def source_targets(sources: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """Add ``target`` to a table of (source, source_size): a row per source.

    Sources in code point order, null last, weigh 1, 2, 3 and again. A target above ``max_passes``
    times its source's size stops there and the excess goes to the others by weight. With sources
    in order of that limit over their weight, the ones that stop come first: each is tested
    against the share per weight that is left after those before it.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("weight", F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1)
    limit = F.col("source_size") * max_passes
    by_limit = Window.orderBy(limit / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    shared = ranked.withColumn("share", left.cast("double") / weights.cast("double"))
    stops = limit.cast("double") <= F.col("share") * F.col("weight")
    shared = shared.withColumn("free_share", F.max(F.when(~stops, F.col("share"))).over(everything))
    target = F.when(stops, limit.cast("double")).otherwise(F.col("free_share") * F.col("weight"))
    return shared.select("source", "source_size", target.alias("target"))


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's steps; 93 are enough for any two 64-bit numbers."""
    pair = lambda x, y: F.named_struct(F.lit("a"), x, F.lit("b"), y)
    rest = lambda s: F.pmod(s["a"], F.greatest(s["b"], F.lit(1)))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(pair(s["b"], rest(s)))
    start = pair(a, b)
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["a"])


def _multiplier(source: Column, epoch: int, blocks: Column, seed: int) -> Column:
    """A pseudorandom number coprime to the number of blocks."""
    key = F.concat(F.lit(f"{epoch}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    start = F.pmod(_number(key, seed), blocks) + 1
    return F.filter(F.sequence(start, start + COPRIME_SPAN), lambda x: _gcd(x, blocks) == 1)[0]


def draw_plan(
    targets: DataFrame, block_words: int = BLOCK_WORDS, max_passes: int = MAX_PASSES, seed: int = SEED
) -> DataFrame:
    """Add to each source its blocks, draws in all, words of a cut last draw, and permutation multipliers."""
    size, one = F.col("source_size"), F.lit(1).cast("long")
    quota = F.least(F.floor(F.col("target") + 0.5), size * max_passes)
    plan = targets.withColumn("quota", F.coalesce(quota, F.lit(0)).cast("long"))
    plan = plan.withColumn("blocks", F.ceil(size / F.lit(block_words)).cast("long"))
    plan = plan.withColumn("passes", F.floor(F.col("quota") / F.greatest(size, one)).cast("long"))
    plan = plan.withColumn("rest", F.col("quota") - F.col("passes") * size)
    plan = plan.withColumn("parts", F.ceil(F.col("rest") / F.lit(block_words)).cast("long"))
    blocks = F.greatest(F.col("blocks"), one)
    return plan.select(
        "source",
        "source_size",
        "target",
        "blocks",
        (F.col("passes") * F.col("blocks") + F.col("parts")).alias("draws"),
        F.when(F.col("parts") > 0, F.col("rest") - (F.col("parts") - 1) * block_words).alias("last_words"),
        F.array(*[_multiplier(F.col("source"), e, blocks, seed) for e in range(max_passes)]).alias("multipliers"),
    )


def permuted(number: Column, multiplier: Column, blocks: Column) -> Column:
    """A permutation of 0 … blocks-1 that leaves the last index, the short block's, in its place."""
    near = F.pmod(multiplier * (number + 1) - 1, blocks)
    far = F.pmod(multiplier.cast("decimal(20,0)") * (number + 1).cast("decimal(18,0)") - 1, blocks.cast("decimal(20,0)"))
    return F.when(blocks < 1 << 31, near).otherwise(far.cast("long"))


def slots(
    plan: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED
) -> DataFrame:
    """(shard, source, number, epoch, block, words): the blocks of the mix, a row each.

    ``words`` is how many of the block's first words are taken: all but for a source's last draw.
    """
    total = plan.agg(F.sum("draws")).first()[0] or 0
    shards = max(1, -(-total // shard_blocks))
    last_chunk = F.floor((F.col("draws") - 1) / F.lit(CHUNK)).cast("long")
    chunks = plan.where("draws > 0").select(
        "source", "draws", F.explode(F.sequence(F.lit(0).cast("long"), last_chunk)).alias("chunk")
    )
    chunks = chunks.repartition(max(8, total // (CHUNK * 64)), "source", "chunk")
    numbers = F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("draws")) - 1)
    drawn = chunks.select("source", F.explode(numbers).alias("draw"))
    shard = F.pmod(F.xxhash64(F.lit(seed), "source", "draw"), F.lit(shards))
    counts = drawn.groupBy("source", shard.alias("shard")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = plan.withColumnRenamed("source", "_source")
    counts = counts.join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    counts = counts.repartition(max(8, shards // 64), "source", "shard")
    numbered = counts.withColumn("number", F.explode(F.sequence("base", F.col("base") + F.col("n") - 1)))
    numbered = numbered.withColumn("epoch", F.floor(F.col("number") / F.col("blocks")).cast("int"))
    index = permuted(F.pmod("number", "blocks"), F.col("multipliers")[F.col("epoch")], F.col("blocks"))
    numbered = numbered.withColumn("block", index)
    full = F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words)
    is_last = (F.col("number") == F.col("draws") - 1) & F.col("last_words").isNotNull()
    words = F.when(is_last, F.least(full, "last_words")).otherwise(full)
    return numbered.select("shard", "source", "number", "epoch", "block", words.alias("words"))


def placed(sized: DataFrame, rows: int, seed: int = SEED) -> DataFrame:
    """Add ``start`` to rows of (key, source, size): the row's first word in its source's stream.

    Rows follow a hash of their key; ties follow key and size, and rows equal in all are alike.
    Buckets of that hash are ordered apart and joined by running totals per bucket.
    """
    buckets = max(1, rows // BUCKET_ROWS)
    hashed = sized.withColumn("_h", _number(F.coalesce(F.col("key"), F.lit("")), seed))
    hashed = hashed.withColumn("_bucket", F.least(F.floor(F.col("_h") / HASH_RANGE * buckets), F.lit(buckets - 1)).cast("int"))
    spread = hashed.repartition(max(8, buckets), "_bucket")
    source = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    spread = spread.withColumn("_source", F.xxhash64(source))
    inner = Window.partitionBy("_bucket", "_source", "source").orderBy("_h", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = spread.withColumn("_inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    totals = hashed.groupBy("_bucket", "source").agg(F.sum("size").alias("_sum"))
    outer = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(outer), F.lit(0)))
    totals = totals.select(F.col("_bucket").alias("_b"), F.col("source").alias("_s"), "_before")
    found = inside.join(totals, (F.col("_bucket") == F.col("_b")) & F.col("source").eqNullSafe(F.col("_s")))
    return found.withColumn("start", F.col("_before") + F.col("_inside")).drop("_h", "_bucket", "_source", "_inside", "_b", "_s", "_before")


class Mix:
    """One mix of a table: row sizes, the plan of its sources, and the parts of rows that are taken.

    ``rows`` is (key, source, size, hash, copy), ``plan`` a row per source, ``parts`` (key, source,
    size, hash, copy, epoch, low, high): words low … high-1 of a row are taken in that pass.
    """

    def __init__(
        self,
        df: DataFrame,
        id_col: str,
        text_col: str,
        source_col: str,
        block_words: int = BLOCK_WORDS,
        max_passes: int = MAX_PASSES,
        seed: int = SEED,
    ) -> None:
        sized = df.select(
            named(id_col).cast("string").alias("key"),
            named(source_col).cast("string").alias("source"),
            n_words(named(text_col)).alias("size"),
            F.xxhash64(named(text_col)).alias("hash"),
        )
        self.rows = cut_lineage(numbered_copies(sized.repartition("key")))
        totals = self.rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        self.plan = cut_lineage(draw_plan(source_targets(totals, max_passes), block_words, max_passes, seed))
        taken = slots(self.plan, block_words, seed=seed).select(F.col("source").alias("_source"), "epoch", "block", "words")
        laid = placed(self.rows.where("size > 0"), self.rows.count(), seed)
        first, last = (F.floor(x / F.lit(block_words)).cast("long") for x in (F.col("start"), F.col("start") + F.col("size") - 1))
        pieces = laid.withColumn("_block", F.explode(F.sequence(first, last)))
        same = (F.col("_block") == F.col("block")) & F.col("source").eqNullSafe(F.col("_source"))
        begin = F.col("block") * block_words
        low = F.greatest(begin, "start")
        high = F.least(begin + F.col("words"), F.col("start") + F.col("size"))
        found = pieces.join(taken, same).where(low < high)
        self.parts = found.select(
            "key", "source", "size", "hash", "copy", "epoch", (low - F.col("start")).alias("low"), (high - F.col("start")).alias("high")
        )


def numbered_copies(rows: DataFrame) -> DataFrame:
    """Number the rows that are alike in key, source and text, so that each has a name of its own."""
    alike = Window.partitionBy("key", "source", "hash").orderBy(F.lit(0))
    return rows.withColumn("copy", F.row_number().over(alike))


_NAME = ["key", "source", "size", "hash", "copy"]


def words_taken(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """(key, source, size, source_size, target, taken) per row: the words that the mix takes from it.

    ``key`` is the id as text. A null text has size 0, a null source is a source of its own. Words
    are counted as often as they are taken; no row gives more than ``max_passes`` times its size.
    Rows of size 0 give none. Repeated rows are mixed like any other; null ids too. The result is
    the same on every run. Empty tables give no rows.
    """
    mix = Mix(df, id_col, text_col, source_col, **options)
    taken = mix.parts.groupBy(*_NAME).agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    none = mix.rows.where("size = 0").select(*_NAME, F.lit(0).cast("long").alias("taken"))
    rows = mix.rows.where("size > 0")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) if c in ("key", "source") else F.col(f"r.{c}") == F.col(f"t.{c}") for c in _NAME]
    left = rows.alias("r").join(taken.alias("t"), same, "left")
    some = left.select(*[F.col(f"r.{c}").alias(c) for c in _NAME], F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    own = mix.plan.select(F.col("source").alias("_source"), "source_size", "target")
    out = some.unionByName(none).join(own, F.col("source").eqNullSafe(F.col("_source")))
    return out.select("key", "source", "size", "source_size", "target", "taken")


def mix_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", **options
) -> DataFrame:
    """The mix as documents, with the columns of ``df``: a row for each pass that takes words of one.

    A document taken whole keeps its text. One that is taken in part has the taken words, in
    order, with single spaces; ``chars_col``, where the table has it, follows. Documents without words are
    in no block and so not in the mix. Null and repeated values as in ``words_taken``.
    """
    mix = Mix(df, id_col, text_col, source_col, **options)
    spans = F.sort_array(F.collect_list(F.struct("low", "high")))  # at most a row's blocks
    taken = mix.parts.groupBy(*_NAME, "epoch").agg(spans.alias("spans"), F.sum(F.col("high") - F.col("low")).alias("taken"))
    names = {c: scratch_name(df, f"_mix_{c}") for c in ("key", "source", "hash", "copy")}
    whole = df.withColumns(
        {names["key"]: named(id_col).cast("string"), names["source"]: named(source_col).cast("string"), names["hash"]: F.xxhash64(named(text_col))}
    ).repartition(names["key"])
    alike = Window.partitionBy(names["key"], names["source"], names["hash"]).orderBy(F.lit(0))
    whole = whole.withColumn(names["copy"], F.row_number().over(alike))
    taken = taken.select(*[F.col(c).alias(f"_taken_{c}") for c in taken.columns])
    same = [F.col(name).eqNullSafe(F.col(f"_taken_{c}")) for c, name in names.items()]
    met = whole.join(taken, same)
    words = F.regexp_extract_all(named(text_col), F.lit(WORD), F.lit(0))
    some = F.flatten(F.transform("_taken_spans", lambda s: F.slice(words, s["low"] + 1, s["high"] - s["low"])))
    is_whole = F.col("_taken_taken") == F.col("_taken_size")
    text = F.when(is_whole, named(text_col)).otherwise(F.array_join(some, " "))
    changed = {text_col: text}
    if chars_col is not None and chars_col in df.columns:
        kind = df.schema[chars_col].dataType
        changed[chars_col] = F.when(is_whole, named(chars_col)).otherwise(F.length(text).cast(kind))
    return met.select(*[changed[c].alias(c) if c in changed else named(c) for c in df.columns])
