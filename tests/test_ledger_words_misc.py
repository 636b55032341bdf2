"""Ledger against a plain fold and as a stream, locator, manifests, readers, privacy, small formulas."""

import json
import struct
import sys

import pytest
from pyspark.sql import functions as F

from tallyrook.functions import strict_json
from tallyrook.operators import contracts, forms, ledger, manifest, privacy, words
from tallyrook.sources import images, json_sheets, readers
from tallyrook.streaming import ledger_stream


def fold(events):
    """One draft's events in order, by the rules themselves: (outcome, revision, status, detail's first word)."""
    revision, status, stamp, sha, fine, sent, out = 1, "pending", None, events[0].sha, events[0].reviewable, False, []
    for i, e in enumerate(events):
        why = None
        if e.action == "submit":
            outcome = "submitted" if i == 0 else "already_submitted"
        elif e.action == "overwrite":
            outcome, sha, fine = "overwritten", e.sha, e.reviewable
        elif e.action == "simulate":
            why = f"status={status}" if status != "approved" else "already_simulated" if sent else "stale_approval" if stamp != (revision, sha) else "not_reviewable" if not fine else None
            outcome = "simulation_blocked" if why else "simulation_completed"
            sent = sent or not why
        elif e.expected not in (None, revision):
            outcome = "conflict"
        elif sent:
            outcome = "edit_blocked" if e.action == "edit" else "status_blocked"
        elif e.action == "edit":
            outcome = "approval_revoked" if status == "approved" else "edited"
            revision, sha, fine = revision + 1, e.sha, e.reviewable
            status, stamp = ("pending", None) if status == "approved" else (status, stamp)
        elif e.action == "approve":
            outcome, status, stamp = "status:approved", "approved", (revision, sha)
        else:
            outcome, status, stamp = "status:rejected", "rejected", None
        out.append((outcome, revision, status, why))
    return out


def test_outcomes_are_the_fold(spark):
    rows = ledger.outcomes(ledger.of(spark, "/root/testdata/sf0.01")).orderBy("draft_id", "ts", "event_id").collect()
    drafts = {}
    for r in rows:
        drafts.setdefault(r.draft_id, []).append(r)
    assert len(drafts) > 100
    for events in drafts.values():
        got = [(r.outcome, r.revision, r.status, r.detail.split(" ")[0] if r.outcome == "simulation_blocked" else None) for r in events]
        assert got == fold(events)
    seen = {r.outcome for r in rows} | {r.detail.split(" ")[0] for r in rows if r.outcome == "simulation_blocked"}
    assert {"conflict", "approval_revoked", "overwritten", "stale_approval", "simulation_completed"} <= seen


def test_stamps_name_revision_and_content():
    begin, step = ledger.begin, ledger.step
    d = begin("a" * 64, True)
    d, outcome, detail = step(d, True, "approve", None, True, 2)
    assert (outcome, d.status) == ("conflict", "pending") and detail == "rev=1 expected=2"
    d, _, detail = step(d, False, "approve", None, True, 1)
    assert d.approved_revision == 1 and detail == "rev=1 sha256=" + "a" * 12
    stale, _, _ = step(d, False, "overwrite", "b" * 64, True, None)
    assert step(stale, False, "simulate", None, True, None)[1:] == ("simulation_blocked", "stale_approval rev=1 approved_rev=1")
    unfit = d._replace(reviewable=False)
    assert step(unfit, False, "simulate", None, True, None)[2] == "not_reviewable"
    d, outcome, _ = step(d, False, "simulate", None, True, None)
    assert outcome == "simulation_completed" and step(d, False, "simulate", None, True, None)[2] == "already_simulated"
    assert step(d, False, "edit", "c", True, None)[1:] == ("edit_blocked", "already_simulated")


def test_stream_is_the_batch(spark, sf, tmp_path):
    events = ledger.of(spark, sf)
    events.repartition(1).sortWithinPartitions("ts", "event_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = ledger_stream.outcomes(stream).writeStream.format("memory").queryName("ledger_out").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql("select event_id, outcome, detail, revision from ledger_out")
    want = ledger.outcomes(events).select("event_id", "outcome", "detail", "revision")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_pages_and_cursor(spark, sf):
    drafts = ledger.drafts(ledger.of(spark, sf))
    page = ledger.queue_page(drafts, 3).collect()
    assert len(page) == 4
    again = ledger.queue_page(drafts, 3, (str(page[2].created_at), page[2].draft_id)).collect()
    assert again[0].draft_id == page[3].draft_id
    with pytest.raises(ValueError):
        ledger.queue_page(drafts, 0)
    bad = spark.createDataFrame([("not base64!",), ("WyJ4Il0",)], "c string").select(ledger.decoded(F.col("c")).alias("x")).collect()
    assert [r.x for r in bad] == [None, None]


def test_locator(spark):
    box = "doc_id long, page int, line int, pos int, word string, conf double, line_key string, x0 double, y0 double, x1 double, y1 double"
    made = [(1, 0, ln, i, w, 0.9, str(ln), i / 10, ln / 10, i / 10 + 0.05, ln / 10 + 0.05) for ln, t in enumerate(["Joao da Silva", "07:30 porta Joao"]) for i, w in enumerate(t.split())]
    values = spark.createDataFrame([(1, 0, 1, "JOÃO da silva"), (1, 0, 2, "porta 07:30 aberta"), (1, 0, 3, "zzz"), (1, 0, 4, "07 30")], "doc_id long, page int, value_id int, value string")
    got = {r.value_id: r for r in words.located(spark.createDataFrame(made, box), values).collect()}
    assert (got[1].method, got[1].score, got[1].x0, got[1].n_words) == ("exact", 1.0, 0.0, 3)
    assert got[2].method == "token_window" and got[2].score == pytest.approx(2 / 3) and got[3].method == "none" and got[4].method == "none"


def test_manifests(spark, tmp_path):
    sha = "a" * 64
    rows = [{"doc_id": "tc-000001", "split": "val", "image": "pngs/tc-000001.png", "gt": "gt/tc-000001.json", "sha256_img": sha, "sha256_gt": sha}]
    rows += [dict(rows[0], doc_id="tc-1"), dict(rows[0], doc_id="tc-000002", image="pngs/tc-000002.png", sha256_gt="x"), dict(rows[0], doc_id="tc-000003", image="pngs/tc-000003.png", gt="gt/tc-000003.json", split="test")]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = {r.doc_id: r.error for r in json_sheets.manifest(spark, str(tmp_path / "m.jsonl"), "val").collect()}
    assert got == {"tc-000001": None, "tc-1": "bad id", "tc-000002": "bad hash", "tc-000003": "wrong split"}
    (tmp_path / "n.jsonl").write_text(json.dumps(rows[0]) + "\n" + json.dumps(rows[0]))
    assert {r.error for r in json_sheets.manifest(spark, str(tmp_path / "n.jsonl")).collect()} == {"repeated doc_id"}
    (tmp_path / "o.jsonl").write_text("")
    with pytest.raises(ValueError):
        json_sheets.manifest(spark, str(tmp_path / "o.jsonl"))
    a = spark.createDataFrame([dict(rows[0], doc_id=f"tc-{i:06d}") for i in range(3000)])
    one = lambda df: contracts.manifest_sha(df).collect()[0]
    assert one(a) == one(a.orderBy(F.desc("doc_id"))) and one(a).sha != one(a.where("doc_id <> 'tc-000007'")).sha and one(a.limit(0)).n_rows == 0
    verdicts = spark.createDataFrame([('{"a":1,"a":2}',), ('{"a":NaN}',), ("{",), ('{"a":1}',), (None,)], "t string").select(strict_json.verdict(F.col("t")).alias("v")).collect()
    assert [r.v for r in verdicts] == ["duplicate key", "not a number", "not JSON", "ok", "not JSON"]


def test_truth_sheets(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"document_id": "a", "review_status": "draft", "ocorrencias": []}))
    (tmp_path / "b.json").write_text(json.dumps({"document_id": "b", "review_status": "verified_by_user", "cabecalho": {"vigilantes": ["x"]}}, indent=2))
    assert [r.document_id for r in json_sheets.truth_sheets(spark, str(tmp_path), ["verified_by_user"]).collect()] == ["b"]


def png(w, h):
    return images.PNG + b"\0\0\0\rIHDR" + struct.pack(">II", w, h) + b"x"


def test_image_heads():
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 30, 40) + b"\x03" * 20
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -9)
    entry = lambda tag, v: struct.pack("<HHII", tag, 4, 1, v)
    page = struct.pack("<H", 2) + entry(256, 5) + entry(257, 6)
    tiff = b"II*\0" + struct.pack("<I", 8) + page + struct.pack("<I", 8 + len(page) + 4) + page + struct.pack("<I", 0)
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    pdf = b"%PDF-1.4 /Type /Pages /Type /Page /MediaBox [0 0 72 144]"
    assert images.measured(png(3, 4), "png", 150)[:3] == (3, 4, 1) and images.measured(jpeg, "jpg", 150)[:3] == (40, 30, 1)
    assert images.measured(bmp, "bmp", 150)[:3] == (7, 9, 1) and images.measured(tiff, "tif", 150)[:3] == (5, 6, 2)
    assert images.measured(webp, "webp", 150)[:3] == (100, 50, 1) and images.measured(pdf, "pdf", 150)[:3] == (150, 300, 1)
    for kind in (*images.HEADS, "pdf"):
        for junk in (b"", b"no", png(1, 1)[:20], tiff[:30], b"\xff\xd8"):
            assert images.measured(junk, kind, 150)[3]


def test_images_and_readers(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(30, 40))
    (tmp_path / "b.png").write_bytes(b"no")
    (tmp_path / "d.PNG".lower()).write_bytes(png(6000, 5000))
    (tmp_path / "c.txt").write_bytes(b"no")
    got = {r.path.rpartition("/")[2]: r for r in images.pages(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.png", "b.png", "d.png"} and got["a.png"].png_valid and not got["b.png"].png_valid
    assert got["a.png"].reject_reason is None and got["a.png"].content and got["b.png"].reject_reason.startswith("unreadable") and got["b.png"].content is None
    assert got["d.png"].reject_reason == "too many pixels"
    pages = spark.createDataFrame([(1, 0, b"ol\xc3\xa1")], "doc_id long, page int, content binary")
    assert readers.evaluation_reader("text")(pages).collect()[0].text == "olá" and readers.reader("mock")(pages).collect()[0].source == "mock"
    for find, name in ((readers.reader, "nope"), (readers.reader, "text"), (readers.evaluation_reader, "nope")):
        with pytest.raises(ValueError):
            find(name)


def test_external_engine(spark, tmp_path):
    """A program that knows one language, takes its time over some pages, and prints the engine's table."""
    rows = ["\t".join(readers.COLUMNS)] + [f"5\t1\t1\t1\t{ln}\t{i}\t0\t0\t9\t9\t{c}\t{w}" for ln, i, c, w in ((1, 1, 90, "ola"), (1, 2, -1, "mundo"), (2, 1, 70, "fim"))]
    script = tmp_path / "engine"
    script.write_text(f"#!{sys.executable}\nimport sys, time\ndata = sys.stdin.buffer.read()\nif 'por' in sys.argv:\n    sys.exit(1)\nif data == b'slow':\n    time.sleep(30)\nprint({chr(10).join(rows)!r})\n")
    script.chmod(0o755)
    pages = spark.createDataFrame([(1, 0, b"x"), (2, 0, b"slow")], "doc_id long, page int, content binary")
    got = {r.doc_id: r for r in readers.reader("tesseract")(pages, seconds=5.0, command=str(script)).collect()}
    assert (got[1].text, got[1].confidence, got[1].error) == ("ola mundo\nfim", 0.8, None) and got[1].source.endswith(":eng")
    assert got[2].error == "processing deadline exceeded" and got[2].text == ""
    assert readers.reader("tesseract")(pages, command="no-such-engine").collect()[0].error == "reader_unavailable"


def test_deadline():
    now = [0.0]
    d = images.Deadline(10, lambda: now[0])
    now[0] = 7
    assert d.remaining() == 3 and d.bounded(2) == 2 and d.bounded(50) == 3
    now[0] = 10
    with pytest.raises(TimeoutError):
        d.remaining()


def test_privacy(spark):
    text = "em 2026-01-01T10:20:30+00:00\nàs 07:30 h\n/home/ana/x\nC:\\Users\\ana\nfala com Termo Secreto\nda ACME, não da acmes"
    got = privacy.findings(spark.createDataFrame([(1, text)], "doc_id long, text string"), ("termo secreto",), ("acme",)).orderBy("line").collect()
    assert [(r.line, r.category) for r in got] == [(2, "clock-time"), (3, "local-home-path"), (4, "local-home-path"), (5, "private-term"), (6, "organization-sentinel")]


def test_wrapping(spark):
    lines = spark.createDataFrame([(["aa", "bb", "ccccccc", "d"],), ([],)], "w array<string>").select(forms.wrapped(F.col("w"), 5).alias("x")).collect()
    assert [r.x for r in lines] == [["aa bb", "ccccccc", "d"], []]
    wide = lambda line: F.length(line) + 2 * (F.length(line) - F.length(F.replace(line, F.lit("m"))))
    assert spark.range(1).select(forms.wrapped(F.split(F.lit("mm ii ii"), " "), 8, wide).alias("x")).first().x == ["mm", "ii ii"]
