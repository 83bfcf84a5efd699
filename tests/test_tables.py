"""Vault, integrity, limits, lines, sources and streams; brute force where it helps."""

import datetime
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from inkwell.operators.chat import followup_context
from inkwell.operators.crosscheck import resolve
from inkwell.operators.integrity import field_findings, font_findings, label_findings, overlap_findings, risk_score
from inkwell.operators.limits import _in_runs, replay_limits
from inkwell.operators.lines import _pairs, join_pages, merge_passes, text_layer_report, with_corners
from inkwell.operators.retention import retention_plan
from inkwell.operators.star import fan_out, migrate, write_star
from inkwell.operators.statements import statement_rows
from inkwell.operators.vault import for_owner, owner_stats_for, page, vault_filter, with_status_category
from inkwell.schemas import JOB_EVENTS, REQUESTS
from inkwell.sources import store
from inkwell.sources.encryption import backfill_encrypt, decrypt_column, encrypt_column
from inkwell.sources.files import triage_files
from inkwell.sources.images import blur_findings, image_quality
from inkwell.sources.logs import read_log, write_log
from inkwell.sources.vault_index import read_vault_index
from inkwell.streaming import jobs
from inkwell.streaming.limiter import rate_limit_stream, state_on_disk

BOX = "doc_id long, page_num int, line_no int, text string, confidence double, x0 double, y0 double, x1 double, y1 double"


def boxes(seed, docs, per_doc, spread=400):
    rnd = random.Random(seed)
    rows = []
    for d in range(docs):
        for i in range(per_doc):
            x, y = rnd.randint(0, spread), rnd.randint(0, spread)
            rows.append((d, 1, i, f"text {i}", rnd.random(), float(x), float(y), float(x + rnd.randint(5, 90)), float(y + rnd.randint(5, 40))))
    return rows


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0, 0.0
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return w * h / (area(a) + area(b) - w * h), w * h / min(area(a), area(b))


def test_overlap_equals_all_pairs(spark):
    rows = boxes(1, 60, 8)
    got = {r.doc_id for r in overlap_findings(spark.createDataFrame(rows, BOX)).collect()}
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[2] < b[2]:
                iou, share = overlap(a[5:], b[5:])
                if iou >= 0.15 or share >= 0.45:
                    want.add(a[0])
    assert got == want and 0 < len(want) < 60


def test_merge_passes_equals_greedy(spark):
    en, dev = boxes(2, 12, 9, 250), boxes(3, 12, 9, 250)
    dev = [(*r[:3], ("नाव " if r[2] % 2 else "") + r[3], *r[4:]) for r in dev]
    got = sorted((r.doc_id, r.text, r.confidence) for r in merge_passes(spark.createDataFrame(en, BOX), spark.createDataFrame(dev, BOX)).collect())
    want = []
    for d in range(12):
        lines_en, lines_dev = [r for r in en if r[0] == d], [r for r in dev if r[0] == d]
        used = set()
        for a in lines_en:
            best, best_share = None, 0.0
            for b in lines_dev:
                iou, share = overlap(a[5:], b[5:])
                if b[2] not in used and (iou >= 0.35 or share >= 0.50) and share > best_share:
                    best, best_share = b, share
            if best is None:
                want.append(a)
                continue
            used.add(best[2])
            script = "नाव" in best[3]
            dev_wins = (best[4] >= 0.5 or best[4] >= a[4] - 0.2 or a[4] <= best[4]) if script else best[4] > a[4]
            want.append(best if dev_wins else a)
        want += [b for b in lines_dev if b[2] not in used]
    assert got == sorted((r[0], r[3], r[4]) for r in want)


def test_merge_passes_of_repeated_and_missing_numbers(spark):
    """Lines of one number are all partners of the other pass' line; a line without a number takes a partner and joins nobody."""
    en = [(1, 1, 1, "a", 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, 1, "b", 0.3, 0.0, 0.0, 10.0, 10.0), (1, 1, None, "c", 0.9, 0.0, 100.0, 10.0, 110.0)]
    dev = [(1, 1, 1, "d", 0.5, 0.0, 0.0, 10.0, 10.0), (1, 1, 2, "e", 0.5, 0.0, 100.0, 10.0, 110.0), (None, 1, 1, "f", 0.5, 0.0, 0.0, 10.0, 10.0)]
    got = merge_passes(spark.createDataFrame(en, BOX), spark.createDataFrame(dev, BOX)).collect()
    assert sorted((r.text, r.source_pass) for r in got) == [("a", "en"), ("c", "en"), ("d", "dev"), ("e", "dev"), ("f", "dev")]


def test_merge_passes_shuffles_texts_once(spark):
    rnd = random.Random(6)
    en, dev = ([(*r[:3], "".join(map(chr, rnd.choices(range(97, 123), k=400))), *r[4:]) for r in boxes(seed, 12, 9, 250)] for seed in (2, 3))
    size = sum(len(r[3]) for r in (*en, *dev))

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        assert len(merge_passes(spark.createDataFrame(en, BOX), spark.createDataFrame(dev, BOX)).collect()) > 100
        assert 0 < shuffled() - before < 1.5 * size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_labels_and_fonts(spark):
    rows = [(1, 1, i, t, 0.9, 50.0, i * 30.0, 90.0, i * 30.0 + h) for i, (t, h) in enumerate(
        [("Name: A", 20), ("Name: B", 20), ("Father's Name: C", 60), ("x", 60), ("y", 20), ("z", 20)])]
    lines = spark.createDataFrame(rows, BOX)
    for kind, count in (("pan", 2), ("bank_statement", 0)):
        docs = spark.createDataFrame([(1, kind)], "doc_id long, doc_type string")
        assert label_findings(lines, docs).count() == count
    assert font_findings(lines).count() == 1


def test_risk_bands(spark):
    f = spark.createDataFrame([
        (1, 0, "invalid_checksum", 30, "a"), (2, 0, "invalid_checksum", 30, "a"), (2, 1, "invalid_checksum", 30, "b"), (2, 2, "qr_mismatch", 0, "c"),
        (4, 0, "abnormal_alignment", 10, "a"), (4, 1, "abnormal_alignment", 15, "a"),
    ], "doc_id long, ordinal long, signal string, score int, description string")
    docs = spark.createDataFrame([(0, "pan"), (1, "pan"), (2, "pan"), (3, "unknown"), (4, "pan")], "doc_id long, doc_type string")
    got = {r.doc_id: (r.risk_score, r.verification_status, r.priority, r.suspicious_signals) for r in risk_score(f, docs).collect()}
    assert got == {
        0: (0, "verified", "low", []), 1: (30, "review_required", "normal", ["a"]), 2: (85, "review_required", "high", ["a", "b", "c"]),
        3: (0, "unsupported", "low", []), 4: (17, "verified", "low", ["a"]),
    }


def test_field_findings(spark):
    fields = spark.createDataFrame([
        (1, "gross_salary", "50,000"), (1, "total_deductions", "5000"), (1, "net_pay", "40000"), (2, "opening_balance", "100"),
        (2, "closing_balance", "500"), (3, "pan_number", "ABCPE1234F"), (3, "gstin", "ABCPE 1234F"), (4, "licence_number", "BAD"),
        (5, "passport_number", "Z1234567"),
    ], "doc_id long, field string, value string")
    docs = spark.createDataFrame([(1, "salary_slip", ""), (2, "bank_statement", ""), (3, "other", ""), (4, "driving_licence", ""), (5, "passport", "P<IND<<")],
                                 "doc_id long, doc_type string, full_text string")
    totals = spark.createDataFrame([(2, "300", "100")], "doc_id long, credit_amount string, debit_amount string")
    today = datetime.date(2026, 1, 1)
    got = {(r.doc_id, r.signal) for r in field_findings(fields, docs, totals, today=today).collect()}
    assert got == {(1, "math_inconsistency"), (2, "balance_inconsistency"), (3, "duplicate_field_label"), (4, "invalid_checksum"), (5, "invalid_checksum")}
    strict = {(r.doc_id, r.signal) for r in field_findings(fields, docs, totals, today=today, strict_reference=True).collect()}
    assert strict == got - {(2, "balance_inconsistency"), (4, "invalid_checksum")}


VAULT = [
    ("d1", "u", "pan_card.pdf", "pan", "PAN Card", "offline", "completed", "verified", False, 5, None, True, "ABCDE1234F"),
    ("d2", "u", "gst_doc.pdf", "gst_certificate", "GST Registration Certificate", "offline", "warning", "review_required", True, 45, None, True, "GOODS"),
    ("d3", "u", "invoice.pdf", "ai_analyzed", "Tax Invoice", "ai", "completed", "verified", False, 10, None, False, "TOTAL 15000"),
    ("d4", None, "receipt.png", "unknown", "Unknown Document", "offline", "low_confidence", "unsupported", False, 0, None, True, "content"),
    ("d5", "v", "corrupt.pdf", "unknown", "Unknown Document", "offline", "failed", "failed", False, 100, None, True, ""),
]
VAULT_COLS = ("document_id string, user_id string, filename string, doc_type string, document_type string, mode string, status string, "
              "verification_status string, review_required boolean, risk_score int, checksum_valid boolean, ocr_required boolean, extracted_text string")


def test_vault_five(spark):
    v = spark.createDataFrame(VAULT, VAULT_COLS)
    ids = lambda df: sorted(r.document_id for r in df.collect())
    assert ids(vault_filter(v, mode="ai")) == ["d3"]
    assert ids(vault_filter(v, mode="all", status="verified")) == ["d1", "d3"]
    assert ids(vault_filter(v, status="review")) == ["d2"]
    assert ids(vault_filter(v, status="unsupported")) == ["d4"] and ids(vault_filter(v, status="failed")) == ["d5"]
    assert ids(vault_filter(v, status="warning")) == ["d2"]
    assert ids(vault_filter(v, doc_type="GST")) == ["d2"] and ids(vault_filter(v, search="15000", ocr_required=False)) == ["d3"]
    assert [r.status_category for r in with_status_category(v, "table").orderBy("document_id").collect()] == [
        "verified", "review_required", "verified", "unsupported", "failed"]
    assert ids(for_owner(v, "u", "u")) == ["d1", "d2", "d3", "d4"] and ids(for_owner(v, "v")) == ["d5"]
    rows = page(v, 2, 2, newest="risk_score").collect()
    assert [r.document_id for r in rows] == ["d3", "d1"] and {(r.total, r.total_pages) for r in rows} == {(5, 3)}
    stats = owner_stats_for(v.withColumn("file_size", F.lit(1)), spark.createDataFrame([("u",), ("none",)], "user_id string"))
    assert {r.user_id: (r.total_documents, r.success_rate) for r in stats.collect()} == {"u": (3, 66.7), "none": (0, 100.0)}


def test_retention(spark):
    index = spark.createDataFrame([("a", "2025-01-01 00:00:00"), ("b", "2025-02-20 00:00:00"), ("c", "2025-02-20 00:00:00"), ("e", "2025-01-30 00:00:00")],
                                  "document_id string, uploaded_at string")
    files = spark.createDataFrame([("a",), ("b",), ("x",), ("x",), ("e",)], "file_doc_id string")
    plan, summary = retention_plan(index, files, "2025-03-01 00:00:00", 30)
    assert {r.document_id: r.action for r in plan.collect()} == {"a": "expired", "c": "broken_reference", "x": "orphan_file"}
    assert summary.first().asDict() == {"deleted_count": 2, "expired_count": 1, "broken_refs_count": 1, "orphans_cleaned": 2}
    assert retention_plan(index, files, "2025-03-01 00:00:00", 0)[1].first().expired_count == 0


def replay(rows, limit, window):
    kept, out = {}, {}
    for event, ts, client, bucket in sorted(rows, key=lambda r: (r[1], r[0])):
        recent = [t for t in kept.get((bucket, client), []) if t > ts - window]
        ok = len(recent) < limit
        out[event] = ok
        kept[bucket, client] = recent + [ts] if ok else recent
    return out


def requests_frame(spark, rows):
    base = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(e, base + datetime.timedelta(seconds=t), c, b) for e, t, c, b in rows], REQUESTS)


def test_limits_equal_brute_force_and_stream(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([rnd.uniform(0, 4000), rnd.uniform(0, 300)]), rnd.choice([1, 1, 1, 2]), rnd.choice(["upload", "cleanup"])) for i in range(900)]
    rows = [(e, round(t, 3), c, b) for e, t, c, b in rows]
    want = replay(rows, 3, 60)
    frame = requests_frame(spark, rows)
    caps = {"upload": 3, "cleanup": 3}
    got = replay_limits(frame, caps).collect()
    assert {r.event_id: r.accepted for r in got} == want and not all(want.values())
    assert all((r.retry_after is None) == r.accepted and (r.accepted or 1 <= r.retry_after <= 60) for r in got)
    # three batches, rows of the second up to half a minute late, and a clock that passes the watermark
    parts = [[r for r in rows if int((r[1] + (r[0] % 3) * 15) // 1400) == k] for k in range(3)] + [[(None, 9000.0, 0, "clock")]]
    for part in parts:
        requests_frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = []
    stream = rate_limit_stream(jobs.file_stream(spark, str(tmp_path / "in"), REQUESTS, files_per_batch=1), caps)
    with state_on_disk(spark):
        jobs.drain(stream, lambda df, _: out.extend(df.collect()), str(tmp_path / "cp"))
    assert {r.event_id: r.accepted for r in out} == want
    assert {r.event_id: r.retry_after for r in out} == {r.event_id: r.retry_after for r in got}


def test_stream_keys_share_their_state(spark, tmp_path):
    """State grows with groups and spans of time, not with clients; clients and ids without a value keep their places."""
    big = 9007199254740993
    rows = [(big + i, round(i % 50 + i / 2000, 4), i % 1500 or None, "upload") for i in range(1500)]
    rows += [(None, 100.0, 1, "upload"), (7, 101.0, None, "upload"), (8, 102.0, None, None)]
    for part in (rows, [(1, 9000.0, 0, "clock")]):
        requests_frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = rate_limit_stream(jobs.file_stream(spark, str(tmp_path / "in"), REQUESTS, files_per_batch=1), {"upload": 1}, 200)
    out = []
    with state_on_disk(spark):
        query = stream.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert {(r.event_id, r.client, r.bucket) for r in out} == {(e, c, b) for e, _, c, b in rows} and len(out) == len(rows)
    assert {(r.event_id, r.retry_after) for r in out if not r.accepted} == {(None, 101), (7, 99)}
    assert 0 < max(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]) < 1000


def test_a_client_is_cut_into_runs(spark):
    """A client that rests goes to many tasks; one that never does, and one whose stretches are left out, stay right."""
    rnd = random.Random(8)
    rows, event = [], 0
    for client, pauses in ((1, 70), (2, 0), (3, 2000)):
        now = 0.0
        for burst in range(40):
            for _ in range(6):
                now += rnd.choice([0, 1, 5.5])
                rows.append((event, round(now, 3), client, "upload"))
                event += 1
            now += pauses * rnd.random() + (pauses > 0) * 55
    want = replay(rows, 3, 60)
    got = replay_limits(requests_frame(spark, rows), {"upload": 3})
    assert {r.event_id: r.accepted for r in got.collect()} == want
    frame = requests_frame(spark, rows).selectExpr(
        "event_id", "bucket", "client", "unix_micros(ts) AS _us", "CAST(floor(unix_micros(ts) / 1200000000) AS BIGINT) AS _chunk"
    )
    alone = {}
    for e, t, c, _ in rows:
        alone[e] = not any(c == c2 and e != e2 and t - 60 <= t2 <= t for e2, t2, c2, _ in rows)
    flagged = frame.join(spark.createDataFrame(list(alone.items()), "event_id long, alone boolean"), "event_id")
    runs = _in_runs(flagged.selectExpr("*", "CASE WHEN alone THEN _us END AS _rested"), 1_200_000_000)
    per = {r.client: r.n for r in runs.groupBy("client").agg(F.countDistinct("_run").alias("n")).collect()}
    starts = {c: sum(alone[e] for e, _, c2, _ in rows if c2 == c) for c in (1, 2, 3)}
    # first requests that come together start no run of their own, but their stretch does
    assert per[1] >= starts[1] > 10 and per[2] == 1 and per[3] >= starts[3] > 25


def test_refused_requests_do_not_count(spark):
    rows = [(i, t, 1, "upload") for i, t in enumerate([0, 1, 2, 3, 59, 60.5, 61.5])]
    got = {r.event_id: r.accepted for r in replay_limits(requests_frame(spark, rows), {"upload": 3}).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: True}


def test_text_layer_equals_joined_text(spark):
    pages = [(1, 1, "  \n"), (1, 2, " ab c \n"), (1, 3, ""), (1, 4, "d  "), (1, 5, " "), (2, 1, " "), (3, 1, "x" * 60)]
    df = spark.createDataFrame(pages, "doc_id long, page_num int, full_text string")
    joined = {r.doc_id: r.full_text for r in join_pages(df).collect()}
    got = {r.doc_id: (r.characters, r.words, r.ocr_required) for r in text_layer_report(df).collect()}
    assert got == {d: (len(t.strip()), len(t.split()), len(t.strip()) < 50) for d, t in joined.items()}


def test_followup_crosses_stretches(spark):
    rows = [("u", 1, i, r, c) for i, (r, c) in enumerate([("user", "What is it?"), ("assistant", "A pan card"), ("user", "Why?"), ("user", "why so?")])]
    df = spark.createDataFrame(rows, "user_id string, document_id long, turn int, role string, content string")
    got = {r.turn: (r.is_followup, r.last_question, r.last_answer) for r in followup_context(df, stretch=2).collect()}
    assert got == {0: (False, None, None), 2: (True, "What is it?", "A pan card"), 3: (True, "What is it?", "A pan card")}


def test_corners(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [5.0, 2.0], [5.0, 8.0], [1.0, 8.0]],)], "bbox array<array<double>>")
    assert tuple(with_corners(df).select("x0", "y0", "x1", "y1").first()) == (1.0, 2.0, 5.0, 8.0)


def test_encryption_round_trip(spark):
    key = b"k" * 32
    df = spark.createDataFrame([(1, bytearray(b"hello")), (2, bytearray(b""))], "id int, payload binary")
    sealed = encrypt_column(df, "payload", key)
    assert all(bytes(r.payload[:4]) == b"ENC1" and len(r.payload) >= 32 for r in sealed.collect())
    assert {r.id: bytes(r.payload) for r in decrypt_column(sealed, "payload", key).collect()} == {1: b"hello", 2: b""}
    assert backfill_encrypt(sealed, "payload", key).filter("migrated").count() == 0
    with pytest.raises(Exception):
        decrypt_column(df, "payload", key).collect()


def test_logs(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"level":"INFO","event":"e","message":"pan ABCPE1234F","api_key":"zzz"}\nnot json\n')
    write_log(read_log(spark, str(tmp_path / "log")), str(tmp_path / "out"))
    row = read_log(spark, str(tmp_path / "out")).first()
    assert (row.level, row.message, row.extras) == ("INFO", "pan [REDACTED_PAN]", {"api_key": "[REDACTED_SECRET]"})


def test_vault_index(spark, tmp_path):
    (tmp_path / "documents.json").write_text('[{"id":"a","doc_type":"pan","fields":{"name":"X"}},{"document_id":"b","ai_analysis":{"summary":"s"}}]')
    got = {r.document_id: r for r in read_vault_index(spark, str(tmp_path / "documents.json")).collect()}
    assert set(got) == {"a", "b"} and got["a"].fields == {"name": "X"} and got["b"].ai_analysis.summary == "s"


def test_triage(spark, tmp_path):
    cases = {
        "ok.pdf": b"junk %PDF-1.4", "ok.png": b"\x89PNG\r\n\x1a\nrest", "ok.webp": b"RIFF0000WEBPx", "bad.png": b"nope", "empty.jpg": b"",
        "note.txt": b"hi", "a..b.pdf": b"%PDF-",
    }
    for name, body in cases.items():
        (tmp_path / name).write_bytes(body)
    got = {r.name: r.reject_reason for r in triage_files(spark, str(tmp_path)).collect()}
    assert got == {"ok.pdf": None, "ok.png": None, "ok.webp": None, "bad.png": "bad_magic_bytes", "empty.jpg": "empty_file",
                   "note.txt": "unsupported_type", "a..b.pdf": "path_traversal"}


def png(path, pixel, w, h):
    raw = b"".join(b"\0" + bytes(pixel(x, y) for x in range(w)) for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    rnd = random.Random(7)
    noise = [[rnd.randint(0, 160) for _ in range(240)] for _ in range(240)]
    png(tmp_path / "sharp.png", lambda x, y: noise[y][x], 240, 240)
    png(tmp_path / "flat.png", lambda x, y: 120, 240, 240)
    png(tmp_path / "small.png", lambda x, y: noise[y][x], 100, 100)
    png(tmp_path / "soft.png", lambda x, y: (x + y) if x < 60 and y < 60 else noise[y][x], 240, 240)
    (tmp_path / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nno more than that")
    rows = image_quality(spark, str(tmp_path)).collect()
    got = {r.origin.rsplit("/", 1)[1]: [i.split(" ")[0] for i in r.issues] for r in rows}
    assert got == {"sharp.png": [], "flat.png": ["excessive_blur"], "small.png": ["low_resolution"], "soft.png": [], "broken.png": ["undecodable"]}
    assert [(r.status, r.reason, r.width, r.blur_score) for r in rows if "broken" in r.origin] == [("error", "undecodable", None, None)]
    assert [r.origin.rsplit("/", 1)[1] for r in blur_findings(spark, str(tmp_path)).collect()] == ["soft.png"]


def test_star_and_migration(spark, tmp_path):
    rows = spark.createDataFrame([("a", "u", "f.pdf", "pan", "offline", "completed", 10, "verified", 5, "text"), ("b", "u", "g.pdf", "gst", "ai", "completed", 1, "verified", 0, None)],
                                 "document_id string, user_id string, filename string, doc_type string, mode string, status string, file_size long, verification_status string, risk_score int, extracted_text string")
    tables = fan_out(rows)
    write_star(tables, str(tmp_path / "star"))
    assert spark.read.parquet(str(tmp_path / "star" / "documents")).count() == 2
    assert tables["ocr_results"].count() == 1
    assert {r.signal for r in tables["document_integrity_checks"].collect()} == {"All integrity checks passed"}
    fresh, summary = migrate(rows, rows.filter("document_id = 'a'"), "owner")
    assert [(r.document_id, r.user_id) for r in fresh.collect()] == [("b", "owner")] and summary.first().skipped == 1
    with pytest.raises(ValueError):
        migrate(rows, rows, " ")


def test_job_stream_latest_state(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("j1", t0, "pending"), ("j1", t0 + datetime.timedelta(seconds=5), "completed"), ("j2", t0, "pending"), ("j2", t0, "processing")]
    spark.createDataFrame(rows, JOB_EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = []
    jobs.drain(jobs.job_status_stream(jobs.file_stream(spark, str(tmp_path / "in"), JOB_EVENTS)), lambda df, _: out.extend(df.collect()), str(tmp_path / "cp"), "update")
    assert {r.job_id: r.status for r in out} == {"j1": "completed", "j2": "processing"}


def _plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_small_scans_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """A table of few bytes is read by one task; its rows go to as many as they ask for."""
    from inkwell import session

    monkeypatch.setattr(session, "DEALT_ROWS", 10)
    spark.range(95).coalesce(1).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    wanted = spark.conf.get("spark.inkwell.scanPartitions")
    spark.conf.unset("spark.inkwell.scanPartitions")
    try:
        parts = [r[0] for r in session.dealt(read, "id").select(F.spark_partition_id()).distinct().collect()]
        assert len(parts) > 5
        assert sorted(r.id for r in session.dealt(read, "id").collect()) == list(range(95))
        assert session.dealt(read.where("id < 0"), "id").count() == 0
    finally:
        spark.conf.set("spark.inkwell.scanPartitions", wanted)


def test_statement_pages_are_parsed_once(spark, capsys):
    pages = spark.createDataFrame([(1, 1, "01-02-2024 PAID 5.00 95.00\n02-02-2024 PAID 5.00 90.00")], "doc_id long, page_num int, full_text string")
    rows = statement_rows(pages)
    assert "Generate" not in _plan(rows, capsys)
    assert [(r.seq, r.amount, r.balance) for r in rows.orderBy("seq").collect()] == [(0, "5.00", "95.00"), (1, "5.00", "90.00")]


def test_pairs_of_boxes_are_met_once_without_a_second_shuffle(spark, capsys):
    """Boxes over several bands give a pair once; no shuffle is spent on taking repeats out."""
    box = "doc_id long, page_num int, line_no int, x0 double, y0 double, x1 double, y1 double"
    one = spark.createDataFrame([(1, 1, 1, 0.0, 10.0, 50.0, 300.0), (1, 1, 2, 0.0, 400.0, 50.0, 410.0)], box)
    two = spark.createDataFrame([(1, 1, 7, 0.0, 70.0, 50.0, 290.0), (1, 1, 8, 0.0, 399.0, 50.0, 411.0)], box)
    pairs = _pairs(one, two)
    assert sorted((r.a_no, r.b_no) for r in pairs.collect()) == [(1, 7), (2, 8)]
    assert "Aggregate" not in _plan(pairs, capsys)


def test_ingest_matches_each_text_once(spark, tmp_path, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    real = jobs.with_fields

    def counted(docs):
        def seen(batches):
            for part in batches:
                calls.add(len(part))
                yield part

        return real(docs.mapInPandas(seen, docs.schema))

    monkeypatch.setattr(jobs, "with_fields", counted)
    texts = [(i, "PASSPORT REPUBLIC OF INDIA\nPassport No: K1234567") for i in range(4)]
    spark.createDataFrame(texts, "doc_id long, full_text string").write.parquet(str(tmp_path / "in"))
    pages = jobs.file_stream(spark, str(tmp_path / "in"), "doc_id long, full_text string")
    jobs.ingest_stream(pages, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert calls.value == 4
    assert spark.read.parquet(str(tmp_path / "out" / "documents")).count() == 4


def test_files_are_sent_to_python_a_few_at_a_time(spark, tmp_path, monkeypatch):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    seen = []
    set_ = type(spark.conf).set
    monkeypatch.setattr(type(spark.conf), "set", lambda conf, key, value: (seen.append((key, value)), set_(conf, key, value))[1])
    rows = spark.range(40).select(F.concat(F.lit("f"), "id").alias("path"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    store.write_files(rows, str(tmp_path / "out"))
    assert (setting, str(store.FILES_SENT)) in seen and spark.conf.get(setting) == before
    assert len(list((tmp_path / "out").iterdir())) >= 40


def test_wanted_names_are_not_broadcast(spark, capsys):
    fields = spark.createDataFrame([(1, "name", "ASHA RAO", None)], "doc_id long, field string, value string, values array<string>")
    expected = spark.createDataFrame([(1, "full_name", "Asha Rao")], "doc_id long, key string, expected string")
    out = resolve(fields, expected)
    (join,) = [line for line in _plan(out, capsys).splitlines() if "Join [doc_id" in line and "_name" in line]
    assert "SortMergeJoin" in join
    assert [(r.extracted, r.found) for r in out.collect()] == [("ASHA RAO", True)]
