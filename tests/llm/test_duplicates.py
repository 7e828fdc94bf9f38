"""Near-duplicate and fingerprint operators against brute force."""

import hashlib

import numpy as np
import pandas as pd
import pytest
import xxhash

from tarmac.llm import lsh, order_minhash, queries, simhash


def plain_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("radius", [0, 3, 4])
def test_blocks_find_what_all_pairs_find(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = base[:200].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
    values = np.unique(np.concatenate([base, near, [np.uint64(0), np.uint64(3)]]))
    ones = np.bitwise_count(values)
    edges = []
    for a in np.unique(ones):
        for b in np.unique(ones[(ones >= a) & (ones <= a + radius)]):
            x, y = values[ones == a], None if a == b else values[ones == b]
            edges.append(simhash.compare_blocks(x, y, radius))
    at = {v: i for i, v in enumerate(values.view(np.int64).tolist())}
    found = [(at[s], at[d]) for s, d in pd.concat(edges).itertuples(index=False)]
    want = [(i, j) for i in range(len(values)) for j in range(i) if (int(values[i]) ^ int(values[j])).bit_count() <= radius]
    assert components(len(values), found) == components(len(values), want)


def test_simhash_query(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    prints = [plain_fingerprint(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = {rows[i][0]: (f"{prints[i]:016x}", rows[c][0]) for i, c in enumerate(components(len(rows), linked))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op3_simhash"](spark, sf_dir).collect()}
    assert got == want


def test_simhash_edge_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(50_000))
    rows = [(5, "A b c d e"), (3, "a B c d e"), (3, "a b c d e"), (8, None), (9, ""), (None, "a b c d e"), (7, "x"), (None, "alone here"), (4, long)]
    df = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, fp string")
    found = {(r.id, r.component) for r in simhash.near_duplicates(df).collect()}
    assert found == {(5, 3), (3, 3), (8, 8), (9, 8), (None, 3), (7, 7), (None, None), (4, 4)}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 4, 7, 8]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def vectors(rng, n=300):
    base = rng.standard_normal((40, 16))
    rows = []
    for i in range(n):
        v = base[i % 40] + rng.standard_normal(16) * (0.02 if i % 3 else 0.4)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2))
    return rows


def test_embeddings_against_all_pairs(spark, monkeypatch):
    rows = vectors(np.random.default_rng(1))
    rows += [(900, rows[3][1], rows[3][2]), (901, rows[3][1], 1 - rows[3][2])]
    unit = lsh.unit_rows(np.array([r[1] for r in rows]))
    cosine = unit @ unit.T
    n = len(rows)
    linked = [(i, j) for i in range(n) for j in range(i) if cosine[i, j] >= 0.93 and rows[i][2] == rows[j][2]]
    monkeypatch.setattr(lsh, "BLOCK", 4)  # buckets meet in pairs of blocks
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.id: (r.n_links, r.component) for r in lsh.near_vectors(df).collect()}
    links = sum(v[0] for v in got.values())
    assert 0.97 * 2 * len(linked) <= links <= 2 * len(linked)
    degree = np.bincount(np.array(linked).ravel(), minlength=n)
    assert all(got[r[0]][0] <= degree[i] for i, r in enumerate(rows))
    agree = sum(got[rows[i][0]][1] == rows[c][0] for i, c in enumerate(components(n, linked)))
    assert agree >= 0.98 * n


def test_embedding_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1)]
    rows += [(7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (11, [1e30, 0.0], 1), (12, [1.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = sorted((r.id or 0, r.n_links, r.component) for r in lsh.near_vectors(df).collect())
    assert got == sorted(
        [(1, 3, 1), (2, 3, 1), (2, 3, 1), (11, 3, 1)] + [(i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12)] + [(0, 0, None)]
    )
    assert lsh.near_vectors(df.limit(0)).count() == 0


def test_order_matters_to_fingerprints():
    words = [f"word{i}" for i in range(400)]
    text = " ".join(words)
    near = " ".join(words[:390])
    turned = " ".join(reversed(words))
    like = lambda a, b: order_minhash.likeness(order_minhash.signature(a), order_minhash.signature(b))
    assert like(text, text) == like("", "") == 1.0
    assert like(text, near) > 0.85 and like(text, turned) < 0.7 and like(text, "") == 0.0
    assert like("aaaa" * 50, "aaaa" * 25) < 1.0  # occurrences are numbered
    assert len(order_minhash.to_hex(order_minhash.signature("x"))) == 4 * order_minhash.BINS


def test_fingerprint_query(spark, sf_dir):
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.QUERIES["op7_fingerprints"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == order_minhash.to_hex(order_minhash.signature(text))
        assert r.near_edited == order_minhash.likeness(order_minhash.signature(text), order_minhash.signature(edited))
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.95


def test_next_rows_over_many_ranges(spark):
    from tarmac.llm.neighbours_in_order import with_next

    ids = [*range(0, 900, 3), None, 6, 6]
    df = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "id long, text string").repartition(7)
    done = with_next(df, lambda run: [(a[0], b[0]) for a, b in zip(run, run[1:], strict=False)], "id long, other long", range_rows=20)
    order = sorted((i for i in ids if i is not None), reverse=True) + [None]
    want = sorted(zip(order, order[1:] + order[:1], strict=True), key=str)
    assert sorted(((r.id, r.other) for r in done.collect()), key=str) == want
    one = spark.createDataFrame([(1, "a")], "id long, text string")
    assert [tuple(r) for r in with_next(one, lambda run: [(run[0][0], run[1][0])], "id long, other long").collect()] == [(1, 1)]
    assert with_next(df.limit(0), lambda run: [], "id long").count() == 0


def test_a_hot_bucket_is_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(lsh, "BLOCK", 64)
    monkeypatch.setattr(lsh, "ENTRIES", 1024)
    assert lsh.task_groups(spark.createDataFrame([(20_000, 313), (10, 1)], "n long, blocks int")) == -(-(20_000 * 313 + 10) // 1024)
    assert lsh.task_groups(spark.createDataFrame([], "n long, blocks int")) == 8
    rng = np.random.default_rng(1)
    near = rng.normal(size=16) + rng.normal(size=(2_000, 16)) * 0.01
    held, compare = spark.sparkContext.accumulator(0), lsh._compare

    def counted(rows, threshold):
        if len(rows) > 4 * lsh.ENTRIES:
            held.add(1)
        return compare(rows, threshold)

    monkeypatch.setattr(lsh, "_compare", counted)
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(near)], "vec_id long, label int, embedding array<double>")
    rows = lsh.near_vectors(df).collect()
    assert held.value == 0 and {r.component for r in rows} == {0} and min(r.n_links for r in rows) == 1999
