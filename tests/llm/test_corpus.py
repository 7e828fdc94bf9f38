"""Extraction, URL filters, mixing, quality, LM scoring and the pipeline."""

import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import oracle_check
from tarmac.llm import gam, html, maxent, mixing, queries, simhash, urls
from tarmac.llm.common import fold


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, sf_dir, name):
    con = oracle_check.connect(sf_dir)
    assert oracle_check.compare(spark, con, name, sf_dir, queries.QUERIES, queries.ORACLES).startswith("ok")


# Extraction


def texts_of(page):
    return [t for t, _, _ in html.blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<br>b &lt;c&gt; <script>x</script><p>q<nav>n</nav>", ["a b <c>", "q"]),
        ("<div class='sidebar'>s</div><div><p>hello <b>wor</b>ld</p></div><footer>f", ["hello world"]),
        ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</table>", ["a b", "c"]),
        ("<div a='>'>x</div><a href=\"/y>z</a> 1 < 2", ["x", "z 1 < 2"]),
        ("<p>one &am", ["one &am"]),
        ("<ul><li>a<li>b</ul><form>f</form><div id=comments><p>c</div>", ["a", "b"]),
        ("<!-- c --><style>p{}</style><textarea>t</textarea><p hidden>h</p>é\xa0x", ["é x"]),
    ],
)
def test_blocks(page, want):
    assert texts_of(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div class='with-sidebar'><article><p>real text</article></div>", ["real text"]),
        ("<div class='post-comments-off'><article><p>real text</article></div>", ["real text"]),
        ("<div class='sidebar'><article><p>the only one</article></div>", ["the only one"]),
        ("<div class='sidebar'><article><p>teaser</article></div><article><p>story</article>", ["story"]),
        ("<article><div class='entry-header'><h1>Title</h1></div><p>text</article>", ["Title", "text"]),
        ("<article><div class='share-price'><p>the price</div></article>", ["the price"]),
        ("<section class='notice-of-motion'><p>moved</section>", ["moved"]),
        ("<div class='search-results'><p>found</div>", ["found"]),
        ("<p><a title=it's>text here</a> and don't stop</p>", ["text here and don't stop"]),
        ("<p title=\"a>b\" data-x='c>d' e = \"f>\">in</p><p x=\"open>out</p>", ["in", "out"]),
        ("<div class='site-footer'>f</div><div class='adSlot'>a</div><div class='comment-list'>c</div><p class='x NAV'>n</p><p>t", ["t"]),
        ("<article><p>story</p><section class=comments><article><p>a reader</article></section></article>", ["story"]),
        ("<article><p>story</p><article class=comment><p>a reader</article></article>", ["story"]),
    ],
)
def test_furniture_is_named_by_whole_classes(page, want):
    assert texts_of(page) == want


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000 + "<p>text",
        "<div>x" * 20_000,
        "<p><b>" * 50_000 + "t",
        "<a b='" * 50_000,
        "<a b=\"'" * 50_000,
        "<ul><li>" * 30_000 + "z",
        "</div>" * 100_000 + "x",
        "<" * 200_000,
        "&amp;" * 100_000,
    ],
)
def test_hostile_markup_takes_linear_time(page):
    start = time.thread_time()
    html.blocks(page)
    assert time.thread_time() - start < 6


def test_text_below_the_depth_limit_stays():
    page = "<div>" * 1000 + "<p>deep</p>" + "</div>" * 1000 + "<p>after</p>"
    assert texts_of(page) == ["deep", "after"]


def test_template_counts_by_brute_force(spark):
    """Subtrees counted by their text instead of hashes, over pages of nested boxes."""
    draw, rows = random.Random(5), []
    parts = [f"<div>box {i}<span>s</span></div>" for i in range(6)] + [f"<ul><li>item {i}</ul>" for i in range(4)]
    for i in range(60):
        chosen = draw.sample(parts, 3)
        rows.append((i, f"http://h{i % 2}.test/", "<section>" + "".join(chosen) + f"<p>own {i}</p></section>"))
    pages_of = defaultdict(set)
    for i, url, page in rows:
        for part in parts:
            if part in page:
                pages_of[url, part].add(page)
    sizes = Counter(url for _, url, _ in {(0, u, p) for _, u, p in rows})
    want = {}
    for i, url, page in rows:
        left = [p for p in re.findall("<div>.*?</div>|<ul>.*?</ul>|<p>.*?</p>", page) if len(pages_of[url, p]) < max(5, 0.4 * sizes[url])]
        want[i] = "\n".join(" ".join(re.sub("<[^>]*>", "", x).split()) for x in left)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract_text(df, min_share=0.4).collect()}
    assert got == want and any("box" in t for t in want.values()) and any("box" not in t for t in want.values())


def test_extraction_query(spark, sf_dir):
    got = {r.page_id: r for r in queries.QUERIES["op2_html"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(p for p in parts if p)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_templates_go_and_passages_stay(spark):
    rows = []
    for i in range(12):
        rows.append((i, "http://a.test/x", f"<div><div>Join us today</div><p>story {i}</p><p>same words</p></div>"))
        rows.append((100 + i, "http://b.test/x", f"<div>top</div><article><div>Tell a friend</div><p>story {i}</p><p>a quote</p></article>"))
        rows.append((200 + i, "http://c.test/x", "<div>one page, copied</div>"))
    rows += [(300, None, None), (301, "nonsense", ""), (302, "http://d.test", "<p>alone</p>")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string")
    done = html.extract_text(df)
    assert done.columns == ["page_id", "url", "text"]
    got = {r.page_id: r.text for r in done.collect()}
    assert [got[i] for i in range(12)] == [f"story {i}" for i in range(12)]
    assert [got[100 + i] for i in range(12)] == [f"story {i}\na quote" for i in range(12)]
    assert {got[200 + i] for i in range(12)} == {"one page, copied"}
    assert (got[300], got[301], got[302]) == ("", "", "alone")
    assert html.extract_text(df.limit(0)).count() == 0


def test_unclosed_inline_elements_in_articles_are_no_template(spark):
    inline = ["b", "i", "em", "strong", "a href='/x'", "span", "font"]
    page = "<article><p>story {}</p>" + "".join(f"<p><{tag}>shared {n}</p>" for n, tag in enumerate(inline)) + "<section>Join us</section></article>"
    df = spark.createDataFrame([(i, "http://e.test/x", page.format(i)) for i in range(40)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract_text(df).collect()}
    assert got == {i: "\n".join([f"story {i}", *(f"shared {n}" for n in range(len(inline)))]) for i in range(40)}


# URL filters


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "http://net?x": ("net", "", None, "allow"),
        "x://y://net/z": ("y:", "//net/z", None, "allow"),
        "http://magnet/": ("magnet", "/", None, "allow"),
        "http://m.example.com/de/1": ("m.example.com", "/de/1", "example.com/de/", "block"),
        "http://example.com/de": ("example.com", "/de", None, "allow"),
        "http://wiki.org/fr/": ("wiki.org", "/fr/", "org/fr/", "allow"),
        "http://www.cheap-pills.example.com/": ("www.cheap-pills.example.com", "/", None, "block"),
        "http://a.com:80/casino": ("a.com:80", "/casino", None, "allow"),
    }
    df = spark.createDataFrame([(u, "r") for u in [*cases, "http://net?x"]], "url string, rule string")
    got = [(r.url, (r.host, r.path, r.rule, r.verdict)) for r in urls.judge_urls(df).collect()]
    assert len(got) == len(cases) + 1 and all(cases[u] == v for u, v in got)
    assert urls.judge_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, rules=()).collect()} == {"allow"}


def test_rules_stand_under_their_rarest_token(spark):
    df = spark.createDataFrame([(f"a.com/{i}",) for i in range(9)] + [("b.com/rare",)], "place string")
    rules = [urls.Rule("x", "block", "a", ("com", "rare")), urls.Rule("y", "block", "a", ("absent", "com"))]
    assert {r.rule_no: r.token for r in urls.index_rules(df, rules).collect()} == {0: "rare", 1: "absent"}


# Mixing


def test_targets_stop_at_the_limit(spark):
    sizes = [("a", 10), ("b", 10), ("c", 10), ("d", 970), (None, 0)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    assert got == {"a": 30.0, "b": 30.0, "c": 30.0, "d": 910.0, None: 0.0}


def test_permutations(spark):
    df = spark.range(1).select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(70).cast("long"))).alias("n"))
    df = df.select("n", mixing._multiplier(F.lit("s"), 1, F.col("n"), 42).alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    seen = defaultdict(list)
    for r in df.select("n", "j", mixing.permuted(F.col("j"), F.col("a"), F.col("n")).alias("p")).collect():
        seen[r.n].append((r.j, r.p))
    for n, pairs in seen.items():
        assert sorted(p for _, p in pairs) == list(range(n)) and dict(pairs)[n - 1] == n - 1


def test_mix_edge_cases(spark):
    long = " ".join(["w"] * 5000)
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", None), (None, "x y", None), (4, long, "t"), (5, "z", "t.`u"), (5, "z", "t.`u")]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, source string, n_chars long, key string")
    got = mixing.words_taken(df).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    for source in ("s", "t", "t.`u", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    docs = mixing.mix_documents(df)
    assert docs.columns == df.columns
    words = Counter()
    for r in docs.collect():
        words[r.source] += len(r.text.split())
        assert r.n_chars in (7, len(r.text))
    assert words == Counter({s: sum(r.taken for r in got if r.source == s) for s in ("s", "t", "t.`u", None)})
    assert sorted(map(str, got)) == sorted(map(str, mixing.words_taken(df.repartition(5)).collect()))
    assert mixing.words_taken(df.limit(0)).count() == 0 and mixing.mix_documents(df.limit(0)).count() == 0


def test_each_block_is_drawn_once_a_pass(spark):
    targets = spark.createDataFrame([("a", 1000, 2500.0), ("b", 3000, 100.4)], "source string, source_size long, target double")
    drawn = mixing.slots(mixing.draw_plan(targets, block_words=64), block_words=64, shard_blocks=8).collect()
    assert Counter((r.source, r.epoch, r.block) for r in drawn).most_common(1)[0][1] == 1
    assert Counter({s: sum(r.words for r in drawn if r.source == s) for s in "ab"}) == {"a": 2500, "b": 100}
    assert len({r.shard for r in drawn}) > 3


# Quality


def test_quality_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op10_quality"](spark, sf_dir).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [(labels[d], r) for d, r in got.items() if d in labels and zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(held) > 40 and all(r.held_out for _, r in held)
    assert np.mean([r.predicted == label for label, r in held]) > 0.95
    assert np.mean([r.predicted for label, r in held if label == 1]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_quality_edge_cases(spark):
    rows = [(1, "good plain words here", "s"), (2, None, "s"), (3, "", "s"), (None, "x", "s"), (1, "good plain words here", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    scores = [r.score for r in gam.score_quality(df, gam.train(df, none)).collect()]
    assert scores == [0.5] * 5
    some = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (9, 0)], "doc_id long, quality int")
    done = gam.score_quality(df, gam.train(df, some))
    assert done.columns == df.columns
    by_text = defaultdict(set)
    for r in done.collect():
        by_text[r.text or ""].add(r.score)
    assert all(len(v) == 1 and 0 <= min(v) <= 1 for v in by_text.values())
    assert gam.score_quality(df.limit(0), gam.train(df.limit(0), some)).count() == 0


def test_interactions_are_learned():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert (0, 1) in model.pairs
    test = rng.uniform(size=(2000, 3))
    assert np.mean((model.score(test) > 0.5) == ((test[:, 0] > 0.5) ^ (test[:, 1] > 0.5))) > 0.9


# LM scoring


def test_base_scores_and_gain(spark):
    sf_dir = "/root/testdata/sf0.001"
    words, learned = {}, Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        words[r.doc_id] = [*r.text.encode().lower().split(), None]
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            learned.update(words[r.doc_id])
    n, v = sum(learned.values()), len(learned)
    got = {r.doc_id: r for r in queries.QUERIES["op6_lm"](spark, sf_dir).collect()}
    assert len(got) == len(words)
    for d, tokens in words.items():
        r = got[d]
        base = sum(math.log10((learned[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert math.isclose(base, r.base_score, rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(learned[w] > 0 for w in tokens), n)
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 1) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_is_a_distribution(spark):
    """The probabilities of all words and the unknown of every class add up to 1 in any context."""
    df = spark.createDataFrame([(i, f"a{i % 7} b{i % 3} c the the a{i % 5}") for i in range(60)], "doc_id long, text string")
    packs = maxent.pack_documents(df, "doc_id", "text", F.lit(False))
    counts = maxent.word_counts(packs)
    model = maxent.train(packs, counts)
    rows = counts.collect()
    pack = maxent.Pack.of(packs.first())
    bucket = dict(zip(pack.vocab.view(np.int64).tolist(), pack.buckets(model.head, model.rank).tolist(), strict=True))
    inner = np.zeros(maxent.CLASSES)
    for r in rows:
        inner[model.class_of[bucket[r["hash"]]]] += r["n"] + 0.5
    inner += 10**model.class_log_unknown
    assert np.allclose(inner, 10**model.class_log_total)
    slots = maxent.context_slots(pack.buckets(model.head, model.rank)[pack.stream], pack.starts())
    assert np.allclose(np.exp(maxent.log_softmax(maxent.class_logits(model.weights, slots))).sum(axis=1), 1, atol=1e-5)


def test_context_does_not_cross_documents():
    one, two = maxent._back(np.arange(6), np.array([0, 1, 3]), 1), maxent._back(np.arange(6), np.array([0, 1, 3]), 2)
    s = maxent.START
    assert one.tolist() == [s, s, 1, s, 3, 4] and two.tolist() == [s, s, s, s, s, 3]


def test_lm_edge_cases(spark, monkeypatch):
    rows = [(1, "A b"), (1, "A b"), (None, None), (2, ""), (3, "unseen " * 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    monkeypatch.setattr(maxent, "PACK_TOKENS", 2)
    got = maxent.score_documents(df, F.coalesce(F.col("doc_id") == 3, F.lit(False))).collect()
    assert len(got) == 5 and {r.train_tokens for r in got} == {8}
    assert sorted((r.id or "", r.n_tokens, r.n_known) for r in got) == [("", 1, 1), ("1", 3, 3), ("1", 3, 3), ("2", 1, 1), ("3", 4, 1)]
    alone = maxent.score_documents(df, F.lit(True)).collect()
    assert {r.base_score for r in alone} == {0.0} and {r.n_known for r in alone} == {0}
    assert maxent.score_documents(df.limit(0), F.lit(False)).count() == 0


# Pipeline


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, sf_dir).cache()
    model = gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0))
    good = {r.doc_id for r in gam.score_quality(docs, model).where("score >= 0.3").collect()}
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == docs.columns
    single = corpus_pipeline.drop_near_duplicates(spark, kept, sf_dir).cache()
    first = {r.component for r in simhash.near_duplicates(kept).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(first) and single.columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, single, sf_dir).cache()
    taken = Counter()
    for r in mixing.words_taken(single).collect():
        taken[int(r.key)] += r.taken
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({k: v for k, v in taken.items() if v}) and mixed.columns == docs.columns
    encoded = corpus_pipeline.encode(spark, mixed, sf_dir)
    assert encoded.where(F.col("decoded") != F.col("text").cast("binary")).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixing", "encode"]


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table, name in ((docs, "some"), (docs.limit(0), "none")):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        assert corpus_pipeline.run(spark, folder).columns == [*docs.columns, "ids", "decoded"]
        assert corpus_pipeline.run(spark, folder).count() >= 0




def test_lm_scores_one_pack_at_a_time(spark, capsys):
    """Joined packs reached a worker in batches of up to 10,000 rows, which held a task's packs at once."""
    df = spark.createDataFrame([(i, f"a b c{i}") for i in range(20)], "doc_id long, text string").repartition(3)
    scored = maxent.score_documents(df, F.col("doc_id") % 5 == 1)
    scored.explain()
    plan = capsys.readouterr().out
    assert "CoGroup" in plan and "collect_list" not in plan
    got = {r.id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in scored.collect()}
    assert got == {str(i): (i % 5 == 1, 4, 3 if i % 5 == 1 else 4, 64) for i in range(20)}


def test_texts_reach_workers_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b")], "doc_id long, text string")
    before = spark.conf.get(key)
    try:
        for use in (lambda: maxent.score_documents(docs, fold("doc_id", 5) == 1), lambda: corpus_pipeline.encode(spark, docs, "")):
            for wide in (10_000, 0):  # 0: no limit
                spark.conf.set(key, wide)
                use()
                assert int(spark.conf.get(key)) == 2_000
        spark.conf.set(key, 100)
        corpus_pipeline.encode(spark, docs, "")
        assert spark.conf.get(key) == "100"
    finally:
        spark.conf.set(key, before)


def test_encoded_texts_reach_workers_in_few_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def rows_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([len(batch)] * len(batch))

    docs = spark.range(1_500, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 640).alias("text"))
    before = spark.conf.get(key, None)
    try:
        encoded = corpus_pipeline.encode(spark, docs, "")
        largest = docs.select(F.pandas_udf(rows_of, "int")("text").alias("n")).agg(F.max("n")).first()[0]
        assert 1 < largest <= 300
        assert encoded.where(F.col("decoded") == F.col("text").cast("binary")).count() == 1_500
        spark.conf.set(key, 1)  # less than any text: one row at a time, none lost
        assert corpus_pipeline.encode(spark, docs.limit(20), "").count() == 20
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_pack_is_scored_in_bounded_memory():
    rng = np.random.default_rng(5)
    builder = maxent._Builder()
    for i in range(600):
        builder.add(str(i), i % 5 == 1, " ".join(f"w{k}" for k in rng.integers(0, 3_000, 999)))
    rows = builder.row()
    tokens = 600 * 1_000
    pack = maxent.Pack.of(next(rows.itertuples()))
    assert len(pack.stream) == tokens and pack.stream.max() == 3_000
    assert np.frombuffer(rows["counts"][0], "<u4").tolist() == np.bincount(pack.stream[np.repeat(~pack.held, pack.lengths)], minlength=3_001).tolist()
    head = np.sort(pack.vocab)[: maxent.HEAD]
    rank = np.arange(len(head))
    buckets = pack.buckets(head, rank)[pack.stream].astype(np.int64)
    starts, trained = pack.starts(), np.repeat(~pack.held, pack.lengths)
    want = np.zeros(maxent.ANCHORS * maxent.BUCKETS, dtype=np.int64)
    for steps in (1, 2):
        before = maxent._back(buckets, starts, steps)
        use = trained & (before < maxent.ANCHORS)
        want += np.bincount(before[use] * maxent.BUCKETS + buckets[use], minlength=len(want))
    tracemalloc.start()
    cells = next(maxent._cooccurrence(iter([rows]), head, rank))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = np.zeros_like(want)
    got[cells["cell"]] = cells["n"]
    assert (got == want).all()
    assert peak < 35 * tokens, peak  # whole arrays of eight bytes a token took more than twice that
