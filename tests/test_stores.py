"""Stores and deep pages: JSON arrays in ranges, folders of many files, tables published together, pages at any depth."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.operators.crosscheck import THRESHOLD, cross_check, cross_check_verdicts
from inkwell.functions.similarity import _ratio, length_bound, letter_bound, stage, with_similarity
from inkwell.operators.star import manifest, publish_star, read_star
from inkwell.operators.vault import deep_page, page
from inkwell.plans.catalog import drained, streamed
from inkwell.plans.fixtures import Tables
from inkwell.schemas import VAULT
from inkwell.sources import store
from inkwell.sources.files import triage_files
from inkwell.sources.json_array import array_elements, elements, quotes, read_json_array

ODD = ['a "quoted" word', "back\\slash", "end\\", '"', "{[", "}],", "ünï €", "\\\"", "\n\t", "", ",", "\\\\"]


def records(n, seed=1):
    rnd = random.Random(seed)
    return [
        {"id": str(i), "document_id": str(i) if i % 3 else None, "filename": "".join(rnd.choice(ODD) for _ in range(rnd.randrange(4))),
         "file_size": i * 7, "ocr_required": i % 2 == 0, "suspicious_signals": [rnd.choice(ODD) for _ in range(rnd.randrange(3))], "risk_score": i / 4}
        for i in range(n)
    ]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("split", [7, 64, 1000, 1 << 20])
def test_array_ranges_equal_the_whole_file(spark, tmp_path, indent, split):
    folder = tmp_path / "index"
    folder.mkdir()
    n = 12 if split == 7 else 200
    (folder / "a.json").write_text(json.dumps(records(n), indent=indent, ensure_ascii=False), encoding="utf-8")
    (folder / "b.json").write_text(json.dumps(records(5, 2), indent=indent), encoding="utf-8")
    (folder / "none.json").write_text(" [ ]\n")
    (folder / "empty.json").write_text("")
    (folder / "one.json").write_text(json.dumps(records(1, 3)[0], indent=indent))
    whole = spark.read.schema(VAULT).option("multiLine", True).json(str(folder))
    whole = whole.where("id IS NOT NULL")
    got = read_json_array(spark, str(folder), VAULT, split)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    if split == 64:
        assert array_elements(spark, str(folder), split).where("path LIKE '%a.json'").select("start").distinct().count() > 10


@settings(max_examples=200, deadline=None)
@given(
    value=st.lists(st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.text(st.sampled_from('a"\\{}[],é'), max_size=6)),
                                lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(st.sampled_from('k"\\}'), max_size=3), x, max_size=3)),
                                max_leaves=8), max_size=5),
    split=st.integers(1, 20), indent=st.sampled_from([None, 1]),
)
def test_ranges_hand_out_each_element_once(value, split, indent):
    data = json.dumps(value, indent=indent, ensure_ascii=False).encode()

    def read(start, size):
        return data[start:start + size]

    got, inside, depth = [], False, 0
    for start in range(0, len(data), split):
        got += [e for e in elements(read, start, split, inside, depth, True) if e.strip()]
        for byte in range(start, min(start + split, len(data))):  # the state by plain reading
            char = data[byte:byte + 1]
            if char == b'"':
                run = len(data[:byte]) - len(data[:byte].rstrip(b"\\"))
                inside ^= run % 2 == 0
            elif not inside:
                depth += (char in b"[{") - (char in b"]}")
    assert [json.loads(e) for e in got] == value


def test_folder_of_many_small_files(spark, tmp_path):
    wanted = {}
    for i in range(10_000):
        folder = tmp_path / "in" / f"d{i % 7}" / f"e{i % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        name, body, reason = [(f"{i}.pdf", b"%PDF-1.4", None), (f"{i}.png", b"no", "bad_magic_bytes"), (f"{i}.jpg", b"", "empty_file"),
                              (f"{i}.txt", b"x", "unsupported_type")][i % 4]
        (folder / name).write_bytes(body)
        wanted[name] = (reason, len(body))
    (tmp_path / "in" / "_SUCCESS").write_bytes(b"")
    with open(tmp_path / "in" / "large.png", "wb") as large:  # sparse: 21 MB that nobody reads
        large.truncate(21 * 1024 * 1024)
    wanted["large.png"] = ("too_large", 21 * 1024 * 1024)
    got = triage_files(spark, f"file:{tmp_path}/in").collect()
    assert {r.name: (r.reject_reason, r.length) for r in got} == wanted
    assert all(r.accepted == (r.reject_reason is None) for r in got)


def test_listing_of_one_file_of_nothing_and_of_a_missing_folder(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    (tmp_path / "none").mkdir()
    row = store.list_files(spark, str(tmp_path / "a.bin")).collect()
    assert [(r.name, r.length) for r in row] == [("a.bin", 5)]
    assert store.list_files(spark, str(tmp_path / "none")).collect() == []
    assert triage_files(spark, str(tmp_path / "none")).collect() == []
    heads = store.with_heads(store.list_files(spark, str(tmp_path)), 3).collect()
    assert [bytes(r["head"]) for r in heads] == [b"123"]
    with pytest.raises(Exception, match="missing"):
        store.list_files(spark, str(tmp_path / "missing"))


def test_tables_become_visible_together(spark, tmp_path):
    path = str(tmp_path / "star")
    one = {"documents": spark.createDataFrame([(1, "pan")], "document_id long, doc_type string"), "ocr_results": spark.createDataFrame([(1,)], "document_id long")}
    assert manifest(spark, path) == {}
    assert publish_star(spark, one, path) == 1
    broken = {"documents": one["documents"], "ocr_results": one["ocr_results"].withColumn("bad", F.raise_error(F.lit("stop")))}
    with pytest.raises(Exception, match="stop"):
        publish_star(spark, broken, path)
    assert read_star(spark, path, "documents").count() == 1  # the half that was written is not seen
    assert publish_star(spark, one, path) == 2
    assert [tuple(r) for r in read_star(spark, path, "documents").collect()] == [(1, "pan")] * 2
    assert publish_star(spark, one, path, mode="overwrite") == 3
    assert read_star(spark, path, "ocr_results").count() == 1


@pytest.mark.parametrize("key", ["n", "s"])
def test_deep_pages_equal_pages(spark, key):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, 5, 5, 5, 5, rnd.randrange(40)]), rnd.choice([None, "b", "b", rnd.choice("acdxyz") * 2])) for i in range(900)]
    df = spark.createDataFrame(rows, "document_id long, n long, s string")
    for number, limit in ((1, 20), (12, 20), (23, 20), (45, 20), (46, 20), (2, 400), (1, 0)):
        want = page(df, number, limit, key).collect()
        got = deep_page(df, number, limit, key, ranges=8, small=30).collect()
        assert got == want, (number, limit)
    empty = df.where("false")
    assert deep_page(empty, 1, 20, key, small=0).collect() == []


@settings(max_examples=60, deadline=None)
@given(pairs=st.lists(st.tuples(st.text("abc d1", max_size=12), st.text("abc d1", max_size=12)), min_size=1, max_size=30))
def test_bounds_settle_pairs_as_the_ratio_does(spark, pairs):
    df = spark.createDataFrame(pairs, "one string, two string")
    exact = {(r.one, r.two): r.s for r in with_similarity(df, "one", "two", "s").collect()}
    quick = {(r.one, r.two): r.s for r in with_similarity(df, "one", "two", "s", THRESHOLD).collect()}
    for pair, score in exact.items():
        assert (score >= THRESHOLD) == (quick[pair] >= THRESHOLD)
        assert quick[pair] >= score and (quick[pair] < THRESHOLD or quick[pair] == score)


def test_each_stage_is_right(spark):
    long = "ab" * 150
    pairs = [("abc", "abc"), ("abcd", "abc"), ("abcdefghij", "abc"), ("abcdefgh", "zyxwvuts"), ("abcdefgh", "abcdexgh"), (long, long + "x"), (None, "a")]
    df = spark.createDataFrame(pairs, "one string, two string")
    got = df.select("one", "two", stage(F.col("one"), F.col("two"), THRESHOLD).alias("by"), _ratio("one", "two").alias("ratio"),
                    letter_bound(F.col("one"), F.col("two")).alias("letters"), length_bound(F.col("one"), F.col("two")).alias("length")).collect()
    assert [r.by for r in got] == ["equal", "contained", "contained", "letters", "compared", "compared", None]
    assert all(r.ratio <= r.letters <= r.length for r in got if r.ratio is not None)
    assert got[1].ratio == got[1].length and got[2].ratio == got[2].length


def test_verdicts_without_scores(spark):
    fields = spark.createDataFrame([(1, "name", "RAVI KUMAR", None), (1, "partner_names", None, ["ANITA RAO", "RAVI KUMAR"])],
                                   "doc_id long, field string, value string, values array<string>")
    expected = spark.createDataFrame(
        [(1, "name", "Kumar, Ravi", None), (1, "partners", None, ["Ravi Kumar", "Anita Raoo"]), (1, "partner_name", None, ["Somebody"])],
        "doc_id long, key string, value string, values array<string>")
    full = cross_check(fields, expected).drop("score").collect()
    assert sorted(map(str, cross_check_verdicts(fields, expected).collect())) == sorted(map(str, full))
    assert {r.key: r.matched for r in full} == {"name": True, "partners": True, "partner_name": False}


def test_quotes_behind_backslashes():
    import numpy as np

    text = np.frombuffer(rb'"a\"b\\"c"', np.uint8)
    assert quotes(text, False).tolist() == [0, 7, 9]
    assert quotes(text, True).tolist() == [7, 9]


def test_rule_table_equals_each_page_against_each_rule(spark):
    from inkwell.operators import rule_match
    from inkwell.operators.classify import match_signatures

    rnd = random.Random(4)
    words = ["ALPHA", "BETA", "GAMMA", "DELTA 7", "A.B", "(X)", "ÜBER"]
    patterns = [r"ALPHA\s+BETA", "(?:GAMMA|DELTA) [0-9]", "(?i)beta", r"A\.B", "A.B", r"\(X\)?", "[A-Z]{5}", "X?BER", "NOTHING HERE", r"\QA.B\E", "GAMMA|A", "ALPHA", "ALPHA", r"\p{L}BER", "(ALPHA)*"]
    pages = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=rnd.randrange(6)))) for i in range(60)] + [(60, None), (61, "")], "doc_id long, page_text string")
    rules = spark.createDataFrame([(f"t{i % 4}", "own", p) for i, p in enumerate(patterns)] + [("t", "own", None)], "doc_type string, tier string, pattern string")
    fast = match_signatures(pages, rules)
    assert "Join" not in fast._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, fast.collect()))
    most, rule_match.MOST_LETTERS = rule_match.MOST_LETTERS, 10
    try:
        slow = match_signatures(pages, rules)
        assert any(x in slow._jdf.queryExecution().executedPlan().toString() for x in ("NestedLoop", "Cartesian"))
        assert got == sorted(map(tuple, slow.collect())) and len(got) > 50
    finally:
        rule_match.MOST_LETTERS = most
    assert match_signatures(pages, rules.where("false")).collect() == []


def test_repeated_deliveries_over_batches(spark, tmp_path):
    import datetime

    from inkwell.streaming import jobs

    t0 = datetime.datetime(2024, 1, 1)
    schema = "doc_id long, full_text string, delivered_at timestamp"

    def deliver(*rows):
        made = [(d, f"text {d}", None if m is None else t0 + datetime.timedelta(minutes=m)) for d, m in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    deliver((1, 0), (2, 1), (2, 2), (None, 3), (7, None))
    deliver((1, 10), (3, 11), (7, None))
    deliver((3, 12), (4, 600))
    deliver((5, 601))
    deliver((1, 602))  # comes again long after the watermark has passed it and its state is gone
    out = []
    stream = jobs.once(jobs.file_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1))
    jobs.drain(stream, lambda df, _: out.extend(r.doc_id for r in df.collect()), str(tmp_path / "cp"))
    assert sorted(out, key=str) == [1, 1, 2, 3, 4, 5, 7, 7, None]


def test_deletion_rewrites_only_files_that_hold_the_ids(spark, tmp_path):
    from inkwell.operators import purge

    path = str(tmp_path / "table")
    df = spark.createDataFrame([(i, f"row {i}") for i in range(1000)] + [(None, "no id")], "document_id long, body string")
    assert purge.create(df, path, files=6) == 1
    before = {f: f.read_bytes() for f in (tmp_path / "table" / "data").rglob("*.parquet")}
    doomed = spark.createDataFrame([(5,), (7,), (7,), (None,), (5000,)], "document_id long")
    done = purge.purge(spark, path, doomed, df.schema)
    assert done["deleted"] == 2 and done["kept"] == 999 and done["rewritten"] == 1 and done["untouched"] == 5
    left = purge.read(spark, path, df.schema)
    assert sorted(map(str, left.collect())) == sorted(map(str, df.where("document_id IS NULL OR document_id NOT IN (5, 7)").collect()))
    listed = {r.file.rsplit("/", 1)[1] for r in purge.file_list(spark, path).collect()}
    same = [f for f in before if f.name in listed]
    assert len(same) == 5 and all(f.read_bytes() == before[f] for f in same)
    assert purge.purge(spark, path, doomed, df.schema) == {"deleted": 0, "kept": 999, "rewritten": 0, "untouched": 6}
    assert purge.purge(spark, path, df, df.schema)["kept"] == 1
    assert purge.read(spark, path, df.schema).count() == 1


def test_stream_of_a_table_in_one_file_and_in_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"call {i}") for i in range(20)], "id long, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "conversations.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "written"))
    (part,) = (tmp_path / "written").glob("part-*.parquet")
    (tmp_path / "file").mkdir()
    part.rename(tmp_path / "file" / "conversations.parquet")
    for form in ("file", "folder"):
        tables = Tables(spark, str(tmp_path / form))
        assert sorted(r.id for r in drained(tables, streamed(tables, "conversations")).collect()) == list(range(20))
