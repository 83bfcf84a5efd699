"""Vectors and URLs against brute force; the pipeline against its stages in plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_whole_job import plain_firsts
from inkwell.llm import components, embedding_dedup, neighbours, url_filter

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, root string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def random_rows(n, width, copies, seed=1):
    """Random vectors, near copies of some, scaled and exact copies."""
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, width)).astype(np.float32)
    near = rows[rng.integers(0, 20, copies)] + rng.normal(scale=0.07, size=(copies, width)).astype(np.float32)
    rows = np.concatenate((rows, near.astype(np.float32), rows[:10], 3 * rows[:5]))
    return list(enumerate(rows.tolist()))


def brute_links(rows, threshold):
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(linked)):
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return linked.sum(axis=1), [find(i) for i in range(len(rows))]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 180)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (300, 299), (299, 300)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)} | {299: 299, 300: 299}
    assert components.components(links.where("a < 0")).count() == 0


@pytest.mark.parametrize("tile", [8, 64, 1024])
def test_embedding_links_agree_with_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rows = random_rows(300, 40, 150)
    counts, roots = brute_links(rows, 0.95)
    found = sorted(map(tuple, embedding_dedup.near_duplicates(vectors(spark, rows)).collect()))
    assert counts.sum() > 1000
    assert found == [(i, int(counts[i]), roots[i], roots[i] == i) for i, _ in rows]


@pytest.mark.parametrize("kept", [0, 4])
def test_embedding_rounds_agree_with_brute_force(spark, monkeypatch, kept):
    """Tiles of many blocks, links added up after each of them or at the end."""
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", (4000, 4000))
    monkeypatch.setattr(embedding_dedup, "KEPT_LINKS", kept)
    rows = random_rows(100, 24, 60, seed=3)
    counts, roots = brute_links(rows, 0.95)
    found = sorted(map(tuple, embedding_dedup.near_duplicates(vectors(spark, rows)).collect()))
    assert counts.sum() > 100
    assert found == [(i, int(counts[i]), roots[i], roots[i] == i) for i, _ in rows]


def shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))


def test_embedding_tiles_are_not_shuffled_to_pairs(spark, monkeypatch):
    """Shuffle files left behind stay below the vectors themselves; a copy of a tile for each pair takes many times as much."""
    monkeypatch.setattr(embedding_dedup, "TILE", 32)
    rows = random_rows(900, 64, 20)
    data = vectors(spark, rows)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffle_bytes(spark)
        found = embedding_dedup.near_duplicates(data)
        assert shuffle_bytes(spark) - before < len(rows) * 64 * 4
        assert found.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_embedding_bound_never_stops_a_link():
    rng = np.random.default_rng(4)
    left, right = rng.normal(size=(200, 64)), rng.normal(size=(150, 64))
    right[:50] = left[:50] + rng.normal(scale=0.5, size=(50, 64))
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    for threshold in (0.3, 0.6, 0.9):
        found = {(i, j) for r, c in embedding_dedup.linked_pairs(left, right, axes, threshold, False) for i, j in zip(r, c)}
        unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (left, right)]
        assert found == set(zip(*np.nonzero(unit[0] @ unit[1].T >= threshold)))


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    return vectors(spark, [
        (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, []),
        (6, [nan, 1.0, 0.0]), (7, [inf, 1.0, 0.0]), (8, [None, 1.0, 0.0]), (None, [1.0, -0.0, 0.0]), (9, [0.0, 1e30, 0.0]),
        (10, [0.0, 1e-30, 0.0]), (None, None),
    ])


def test_embedding_odd_rows(spark):
    found = sorted(map(tuple, embedding_dedup.near_duplicates(odd_vectors(spark)).collect()), key=str)
    assert sorted(((i, n, c) for i, n, c, _ in found), key=str) == sorted([
        (1, 3, 1), (2, 3, 1), (2, 3, 1), (None, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8),
        (9, 1, 9), (10, 1, 9), (None, 0, None),
    ], key=str)
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0
    with pytest.raises(Exception, match="components"):
        embedding_dedup.near_duplicates(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])])).collect()


def brute_nearest(rows, query, k):
    x = {i: np.array(v, np.float64) for i, v in rows}
    away = sorted((float(np.sqrt(((x[i] - x[query]) ** 2).sum())), i) for i in x if i != query)
    return away[:k]


def test_neighbours_reach_the_recall(spark):
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in data.collect()]
    found = neighbours.nearest(data, data.where("vec_id % 20 = 0"), 10).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    hits = 0
    for q, got in by_query.items():
        assert got == sorted(got) and len(got) == 10
        hits += len({i for _, i in got} & {i for _, i in brute_nearest(rows, q, 10)})
    assert hits / (10 * len(by_query)) >= 0.9


def test_neighbours_of_few_rows_are_exact_and_ties_go_to_smaller_ids(spark):
    rows = random_rows(60, 12, 20, seed=3)
    table = vectors(spark, rows)
    found = neighbours.nearest(table, table.where("vec_id % 10 = 0"), 10).collect()
    for q in range(0, len(rows), 10):
        got = sorted((r["rank"], r["score"], r["vec_id"]) for r in found if r["query_id"] == q)
        wanted = brute_nearest(rows, q, 10)
        assert [i for _, _, i in got] == [i for _, i in wanted] and [r for r, _, _ in got] == list(range(1, 11))
        assert [s for _, s, _ in got] == pytest.approx([s for s, _ in wanted])


def test_neighbours_odd_rows(spark):
    table = odd_vectors(spark)
    found = sorted(map(tuple, neighbours.nearest(table, table, 10).collect()))
    assert {q for q, *_ in found} == {1, 2, 9, 10}
    assert [(q, r, v) for q, r, v, _ in found if q == 1] == [(1, 1, 2), (1, 2, 2), (1, 3, 10), (1, 4, 9)]
    none = vectors(spark, [])
    assert neighbours.nearest(none, none).count() == 0
    assert neighbours.nearest(table, none).count() == 0


def test_tree_of_equal_vectors_is_one_leaf():
    tree = neighbours.grow(np.ones((500, 4)))
    assert (tree.assign(np.ones((3, 4))) == 0).all() and list(tree.visits(np.zeros(len(tree.centroids)))) == [0]


# URLs

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def plain_judgement(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        stop = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = rest[:stop].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = rest[stop:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "http://", "http://NET", "http://net/", "https://a.Example.NET/en/x?y#z", "http://example.net/enx",
    "http://xexample.net/en/", "ftp://example.com/de/", "x://b.example.com/de", "http://a.org/fr/://net/", "http://a..net/",
    "http://net?/", "http://ÄÖ.net/\n/", "http://" + "a." * 500 + "net/" + "p" * 5000,
]


def test_urls_agree_with_plain_judgement(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("url").union(spark.createDataFrame([(u,) for u in URLS], "url string"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = url_filter.judge(pages, rules).collect()
    assert len(found) == pages.count()
    for r in found:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_judgement(r["url"])


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where(F.xxhash64(F.lit(7), "key") % 12 == 0)
    cascade = url_filter.build(listed, universe)
    assert len(cascade.levels) >= 3  # so false positives of false positives are reached
    wanted = {r["key"] for r in listed.collect()}
    assert {r["key"] for r in universe.where(cascade.contains(F.col("key"))).collect()} == wanted
    nothing = url_filter.build(listed.where("false"), universe)
    assert universe.where(nothing.contains(F.col("key"))).count() == 0
    everything = url_filter.build(universe, universe)
    assert universe.where(~everything.contains(F.col("key"))).count() == 0


def test_urls_odd_rows(spark):
    pages = spark.createDataFrame([("http://a.net/", "h", 1)], "url string, Host string, rule int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    judged = url_filter.judge(pages, rules)
    assert judged.columns == ["url", "Host", "rule", "host_", "path", "rule_", "verdict"]
    assert judged.first()["verdict"] == "block"
    assert url_filter.judge(pages.where("false"), rules).count() == 0
    assert url_filter.judge(pages, rules.where("false")).first()["verdict"] == "allow"


# pipeline


def test_pipeline_stage_by_stage(spark):
    """Every stage keeps the columns of documents, and what it does follows from its operator's own results."""
    from inkwell.llm import bpe, language, minhash, mixing
    from inkwell.llm.common import written

    docs = start = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, SF), "test")
        assert docs.columns == start.columns
        kept[name] = (before, docs)
    before, after = kept["language"]
    und = {r["doc_id"] for r in language.identify(before).where("lang_pred = 'und' OR score < 0.5").collect()}
    assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()} == und
    before, after = kept["near_duplicates"]
    firsts = {r["component_id"] for r in minhash.classes(before).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(firsts)
    rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
    assert sorted(firsts) == plain_firsts(rows)
    before, after = kept["personal_data"]
    assert before.select("doc_id").exceptAll(after.select("doc_id")).count() == 0
    before, after = kept["mixture"]
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(before).where("size > 0").collect()}
    counts = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in taken.items() if n}
    path = corpus_pipeline.tokenizer_path(spark)
    wanted = sorted(map(tuple, bpe.encode(after, path).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == wanted
    text = after.first()
    row = next(r for r in wanted if r[0] == text["doc_id"])
    assert row[3] == hashlib.sha256(text["text"].encode()).hexdigest()


def test_stages_hold_one_python_worker_a_task(spark):
    """No filter makes a function run twice, and no function stands above another: each is a worker more of every task."""
    from inkwell.llm import language, minhash

    rows = [(i, f"{'the old house by the river' if i % 2 else 'das alte Haus am Fluss'} {i // 4}", "de en".split()[i % 2]) for i in range(24)]
    docs = spark.createDataFrame([*rows, *((i, t, None) for i, t, _ in rows[:6]), (None, None, "en"), (None, "", None)], "doc_id long, text string, lang string")

    def functions(df):
        return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")

    told = language.with_known_language(docs)
    assert functions(told) == 1
    assert {r["doc_id"] for r in told.collect()} == set(range(24))
    firsts = minhash.one_of_each(docs)
    assert functions(firsts) == 3  # rows that pass, rows of classes of one, first rows of the others
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id IS NOT NULL").distinct().collect()]
    kept = [r["doc_id"] for r in firsts.collect()]
    assert sorted(i for i in kept if i is not None) == plain_firsts(sorted(set(rows)))
    assert kept.count(None) == 1  # texts without words are one class
