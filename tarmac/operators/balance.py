"""Splits, samples and class balancing.

Every draw orders rows by a hash of their key. The cut for "the first n rows of this class"
is found by counting hash prefixes and looking closer only where the cut falls, so no class
is sorted or ranked in one task; applying it is a comparison per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import scalar as fx
from tarmac.operators.neighbours import knn
from tarmac.operators.skew import join_lookup
from tarmac.schema import col
from tarmac.session import cut_lineage

Keys = str | Sequence[str]
_LEVEL_SHIFTS = (45, 30, 15, 0)
_END = 1 << 60
MAX_CLASSES = 1_000
_BLOCK = 10_000


def row_hash(key: Keys, seed: int = 42) -> Column:
    keys = [key] if isinstance(key, str) else list(key)
    text = col(keys[0]) if len(keys) == 1 else F.concat_ws("|", *[col(k).cast("string") for k in keys])
    return fx.stable_hash(text, seed)


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class; fails when the column is no class label."""
    rows = df.where(col(label).isNotNull()).groupBy(col(label)).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    return {r[0]: r["n"] for r in rows}


def hash_cuts(hashed: DataFrame, ranks: Mapping[object, Sequence[int]]) -> dict[object, list[tuple[int, int]]]:
    """For each class and rank r: (bound, ties) so that r rows have hash < bound, or
    r − ties do and ``ties`` of the rows with hash == bound complete them.

    ``hashed`` has the columns (c, h).
    """
    spark = hashed.sparkSession
    out: dict[object, list] = {c: [None] * len(rs) for c, rs in ranks.items()}
    open_cuts = []  # (class, position, rank still to take, prefix, shift of the prefix)
    for c, rs in ranks.items():
        for i, r in enumerate(rs):
            if r <= 0:
                out[c][i] = (0, 0)
            else:
                open_cuts.append((c, i, r, 0, 60))
    for shift in _LEVEL_SHIFTS:
        if not open_cuts:
            break
        wanted = {(c, prefix) for c, _, _, prefix, _ in open_cuts}
        previous = open_cuts[0][4]
        keep = F.lit(False)
        for c, prefix in sorted(wanted, key=str):
            same = F.col("c") == F.lit(c)
            keep = keep | (same if previous == 60 else same & (F.shiftright("h", previous) == prefix))
        parent = F.lit(0).cast("long") if previous == 60 else F.shiftright("p", previous - shift)
        counted = hashed.where(keep).groupBy("c", F.shiftright("h", shift).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        counted = counted.withColumn("parent", parent)
        # At most 2^15 prefixes per class and parent.
        so_far = Window.partitionBy("c", "parent").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
        counted = counted.withColumn("upto", F.sum("n").over(so_far))
        kind = hashed.schema["c"].dataType.simpleString()
        asked = spark.createDataFrame([(c, prefix, i, need) for c, i, need, prefix, _ in open_cuts], f"c {kind}, parent long, i int, need long")
        hit = counted.join(F.broadcast(asked), ["c", "parent"]).where((F.col("need") <= F.col("upto")) & (F.col("need") > F.col("upto") - F.col("n")))
        found = {(r["c"], r["i"]): r for r in hit.select("c", "i", "p", "n", "upto", "need").collect()}  # a row per open cut
        still_open = []
        for c, i, _, _, _ in open_cuts:
            r = found.get((c, i))
            if r is None:
                out[c][i] = (_END, 0)
            elif r["need"] == r["upto"]:
                out[c][i] = ((r["p"] + 1) << shift, 0)
            elif shift == 0:
                out[c][i] = (r["p"], r["need"] - (r["upto"] - r["n"]))
            else:
                still_open.append((c, i, r["need"] - (r["upto"] - r["n"]), r["p"], shift))
        open_cuts = still_open
    return out


def fixed_size_sample(df: DataFrame, key: Keys, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), the same ones on every run.

    Rows that share the key at the cut are interchangeable, so any of them complete it.
    """
    hashed = df.select(F.lit(0).alias("c"), row_hash(key, seed).alias("h"))
    bound, ties = hash_cuts(hashed, {0: [n]})[0][0]
    sample = df.where(row_hash(key, seed) < bound)
    if not ties:
        return sample
    return sample.unionByName(df.where(row_hash(key, seed) == bound).limit(ties))


def undersample_to(df: DataFrame, label: str, key: Keys, targets: Mapping, seed: int = 42) -> DataFrame:
    """Keep ``targets[class]`` rows of each listed class; other classes stay whole."""
    counts = class_counts(df, label)
    wanted = {c: [t] for c, t in targets.items() if counts.get(c, 0) > t}
    if not wanted:
        return df
    cuts = hash_cuts(df.select(col(label).alias("c"), row_hash(key, seed).alias("h")), wanted)
    h = row_hash(key, seed)
    keep = ~fx.is_member(label, list(wanted))
    for c, [(bound, ties)] in cuts.items():
        keep = keep | ((col(label) == F.lit(c)) & (h < bound))
    out = df.where(keep)
    for c, [(bound, ties)] in cuts.items():
        if ties:
            out = out.unionByName(df.where((col(label) == F.lit(c)) & (h == bound)).limit(ties))
    return out


def stratified_split(
    df: DataFrame,
    label: str | None,
    key: Keys,
    shares: Mapping[str, float],
    seed: int = 42,
    target: str = "split",
) -> DataFrame:
    """Add the split name. Each class is cut at its rounded cumulative shares.

    The split of a row depends on its key, so rows that share a key stay together and the
    parts never overlap. Without a label the whole table is one class.
    """
    names, total = list(shares), sum(shares.values())
    if abs(total - 1.0) > 1e-9:
        raise ValueError("shares must add up to 1")
    strata = F.lit("all") if label is None else col(label)
    hashed = df.select(strata.alias("c"), row_hash(key, seed).alias("h"))
    counts = class_counts(hashed, "c")
    marks = {c: [] for c in counts}
    for c, n in counts.items():
        upto = 0.0
        for name in names[:-1]:
            upto += shares[name]
            marks[c].append(int(n * upto + 0.5))
    cuts = hash_cuts(hashed, marks)
    h = row_hash(key, seed)
    chosen = None
    for c, bounds in cuts.items():
        part = F.lit(names[-1])
        for name, (bound, ties) in reversed(list(zip(names[:-1], bounds))):
            part = F.when((h <= bound) if ties else (h < bound), name).otherwise(part)
        test = strata == F.lit(c)
        chosen = F.when(test, part) if chosen is None else chosen.when(test, part)
    return df.withColumn(target, chosen if chosen is not None else F.lit(None).cast("string"))


def train_val_test(df: DataFrame, label: str, key: Keys, test: float = 0.2, val: float = 0.5, seed: int = 42) -> DataFrame:
    """20 % test, and the rest halved into train and validation by default."""
    rest = 1.0 - test
    return stratified_split(df, label, key, {"test": test, "val": rest * val, "train": rest * (1 - val)}, seed)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = rows / (classes · rows of the class)."""
    counts = df.where(col(label).isNotNull()).groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))  # one row per class
    return counts.select("label", "n", (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, target: str = "weight") -> DataFrame:
    counts = class_counts(df, label)
    rows, k = sum(counts.values()), len(counts)
    return df.withColumn(target, fx.lookup(label, {c: rows / (k * n) for c, n in counts.items()}, 1.0))


def smote(
    df: DataFrame,
    label: str,
    key: str,
    features: Sequence[str],
    targets: Mapping | None = None,
    k: int = 5,
    seed: int = 42,
    **knn_options,
) -> DataFrame:
    """Rows plus synthetic minority rows up to ``targets`` (default: the majority size).

    A class of n rows that lacks m gets ⌊m/n⌋ synthetic rows per base row, and one more for
    the first m mod n in hash order. Neighbour and gap follow from hashes of key and copy
    number. Output: key as text, label, features, is_synthetic.
    """
    features = list(features)
    counts = class_counts(df, label)
    top = max(counts.values(), default=0)
    wanted = dict(targets) if targets is not None else {c: top for c in counts}
    lacking = {c: wanted[c] - counts[c] for c in wanted if c in counts and wanted[c] > counts[c]}
    base_cols = [col(key), col(label), *[col(c).cast("double").alias(c) for c in features]]
    originals = df.select(*base_cols)
    plain = originals.withColumns({key: col(key).cast("string"), "is_synthetic": F.lit(0)})
    if not lacking:
        return plain
    for c in lacking:
        if counts[c] < 2:
            raise ValueError(f"class {c!r} has one row and no neighbour to interpolate with")
    minority = cut_lineage(originals.where(fx.is_member(label, list(lacking))))
    extra = {c: [m % counts[c]] for c, m in lacking.items()}
    cuts = hash_cuts(minority.select(col(label).alias("c"), row_hash(key, seed).alias("h")), extra)
    h, copies, reach = row_hash(key, seed), None, None
    for c, m in lacking.items():
        bound, ties = cuts[c][0]
        one_more = (h <= bound if ties else h < bound).cast("int")
        test = col(label) == F.lit(c)
        number, span = F.lit(m // counts[c]) + one_more, F.lit(min(k, counts[c] - 1))
        copies = F.when(test, number) if copies is None else copies.when(test, number)
        reach = F.when(test, span) if reach is None else reach.when(test, span)
    drawn = (
        minority.withColumns({"_copies": copies, "_reach": reach})
        .where(F.col("_copies") > 0)
        # Copies come in blocks, so a row with very many of them needs no very long array.
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / _BLOCK).cast("int"))))
        .withColumn(
            "_copy",
            F.explode(F.sequence(F.col("_block") * _BLOCK + 1, F.least(F.col("_copies"), (F.col("_block") + 1) * _BLOCK))),
        )
        .withColumn("_draw", F.concat_ws(":", col(key).cast("string"), F.col("_copy").cast("string")))
        .withColumn("rank", (F.pmod(fx.stable_hash(F.col("_draw"), seed + 1), F.col("_reach")) + 1).cast("int"))
        .withColumn("_gap", fx.unit_hash(F.col("_draw"), seed + 2))
    )
    vectors = minority.select(col(key), col(label), F.array(*[col(c) for c in features]).alias("vector"))
    # Written once: the join reads its keys before it reads its rows.
    near = cut_lineage(knn(vectors, key, "vector", k, within=label, seed=seed, **knn_options).select(col(key), "rank", "neighbour"))
    other = minority.select(col(key).alias("neighbour"), *[col(c).alias(f"{c}#other") for c in features])
    paired = join_lookup(join_lookup(drawn, near, [key, "rank"], "inner"), other, ["neighbour"], "inner")
    synthetic = paired.select(
        F.concat(F.lit("synthetic:"), F.col("_draw")).alias(key),
        col(label),
        *[(col(c) + F.col("_gap") * (col(f"{c}#other") - col(c))).alias(c) for c in features],
        F.lit(1).alias("is_synthetic"),
    )
    return plain.unionByName(synthetic)


def tomek_links(df: DataFrame, label: str, key: str, features: Sequence[str], seed: int = 42, **knn_options) -> DataFrame:
    """(left_key, right_key): pairs of different classes that are each other's nearest row."""
    vectors = df.select(col(key), col(label).alias("_label"), F.array(*[col(c).cast("double") for c in features]).alias("vector"))
    vectors = cut_lineage(vectors)
    near = knn(vectors.drop("_label"), key, "vector", 1, seed=seed, **knn_options).select(col(key).alias("a"), F.col("neighbour").alias("b"))
    labels = vectors.select(col(key).alias("k"), "_label")
    near = cut_lineage(near)  # the next join reads its keys before it reads its rows
    both = near.join(labels.withColumnsRenamed({"k": "a", "_label": "la"}), "a")
    both = join_lookup(both, labels.withColumnsRenamed({"k": "b", "_label": "lb"}), ["b"], "inner")
    across = both.where(F.col("la") != F.col("lb"))
    # A mutual pair shows up once from either end.
    pair = [F.least("a", "b").alias("left_key"), F.greatest("a", "b").alias("right_key")]
    return across.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 2).drop("n")


def remove_tomek_links(df: DataFrame, label: str, key: str, features: Sequence[str], **options) -> DataFrame:
    """Drop both members of every Tomek link."""
    links = tomek_links(df, label, key, features, **options)
    gone = links.select(F.explode(F.array("left_key", "right_key")).alias(key))
    return df.join(gone, key, "left_anti")


def smote_tomek(df: DataFrame, label: str, key: str, features: Sequence[str], targets: Mapping | None = None, k: int = 5, seed: int = 42, **knn_options) -> DataFrame:
    """SMOTE, then removal of Tomek links among originals and synthetic rows."""
    grown = cut_lineage(smote(df, label, key, features, targets, k, seed, **knn_options))
    return remove_tomek_links(grown, label, key, features, seed=seed, **knn_options)
