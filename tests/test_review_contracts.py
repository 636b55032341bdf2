"""Review of sheets, contracts of publication, generation: small cases written out."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyrook import config
from tallyrook.operators import classify, contracts, critic, edits, forms, generate, privacy, words

HEAD = "Controle\nData e Turno: 01/02/2026 - Dia\nVigilantes: Ana e Bruno\nUnidade: Norte\nItem Hora Descrição Ação Resolvido\n"
EDIT = f"sheet_id long, data_turno string, vigilantes string, unidade string, radio string, rows {edits.EDIT_ROWS}"


def row(item="camera", hora="07:30", descricao="caiu", acao=None, resolvido=None):
    return (item, hora, descricao, acao, resolvido)


def review(spark, *given):
    texts = [HEAD + "07:30 porta\n", HEAD + "S/A\n", "curto"]
    states = classify.classified(critic.states(spark.createDataFrame(list(enumerate(texts)), "sheet_id long, text string")))
    return {r.sheet_id: r for r in edits.edited(states, spark.createDataFrame(list(given), EDIT)).collect()}


def test_edits(spark):
    got = review(
        spark, (0, "02/02/2026", " Ana , Eva e Li ", None, "com_ocorrencias", [row(hora="22:00 – 23:15", resolvido="sim"), row("furto", None, "sumiu")]),
        (1, "x", "y", "z", "com_ocorrencias", []), (2, "x", "y", "z", "sem_alteracao", []),
    )
    assert got[0].error is None and got[0].new_guards == ["Ana", "Eva", "Li"] and got[0].pending == ["unidade"] and got[0].incident_type == "theft" and got[0].recipients[0] == "tech_security"
    first, second = got[0].edited_rows
    assert (first.entry_time, first.exit_time, first.resolved) == ("22:00", "23:15", True) and second.entry_time is None and second.resolved is None
    assert got[0].status == "Em revisão — 1 campo(s) pendente(s)"
    assert got[1].error == "no rows" and got[1].disposition == "none"
    assert got[2].error is None and got[2].quality == "low" and got[2].pending == [] and got[2].status == "Pronto para gerar/aprovar" and got[2].incident_type == "other"


def test_edits_that_contradict(spark):
    got = review(spark, (0, None, None, None, None, []), (1, None, None, None, "sem_alteracao", [row()]), (2, None, None, None, None, [row()]))
    assert [got[i].error for i in range(3)] == ["no choice", "rows with no change", "rows without choice"]
    got = review(spark, (0, None, None, None, "com_ocorrencias", [row()] * 11), (1, None, None, None, None, []), (2, None, None, None, None, []))
    assert got[0].error == "too many rows" and got[1].error is None and got[1].disposition == "none" and got[2].disposition == "unknown" and "ocorrencias" in got[2].pending


@pytest.mark.parametrize(
    "values, want",
    [(row(), None), (row(hora="7:30"), "bad time"), (row(hora="24:00"), "bad time"), (row(hora="22:00 a 23:00"), None), (row(hora="22:00-23:00"), None), (row(hora="22:00 23:00"), None), (row(hora="22:00;23:00"), "bad time"), (row(item=" "), "item missing"),
     (row(item="x" * 201), "item too long"), (row(descricao="x" * 4000), None), (row(descricao="x" * 4001), "description too long"), (row(acao="x" * 4001), "action too long"), (row(resolvido="talvez"), "bad choice"), (row(hora="\u00a007:30\u00a0"), None)],
)
def test_rows_of_the_form(spark, values, want):
    columns = [F.lit(v).cast("string") for v in values]
    assert spark.range(1).select(forms.row_error(F.lit(1), *columns).alias("e")).first().e == want


def test_keys_of_the_form(spark):
    cases = [(["occ__1__item", "x"], None), (["occ__1__item", "occ__1__item"], "repeated key"), (["occ__0__item"], "number out of range"), (["occ__11__hora"], "number out of range"), (["occ__1__foo"], "unknown key"), ([], None)]
    got = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(cases)], "i int, k array<string>").select("i", forms.key_error(F.col("k")).alias("e")).collect()
    assert {r.i: r.e for r in got} == {i: e for i, (_, e) in enumerate(cases)}


def test_late_sheets_stay(spark):
    base = spark.createDataFrame([(0, HEAD + "07:30 porta aberta com muita gente vendo tudo\n", 1.0), (1, HEAD + "S/A\n", 9.0)], "sheet_id long, text string, seconds double")
    got = {r.sheet_id: r for r in edits.quarantined(critic.states(edits.timed_out(base, F.col("seconds"), 5.0))).collect()}
    assert got[1].draft == edits.BLOCKED.format("processing deadline exceeded") and got[1].incident_type == "unknown" and got[1].remaining == 0 and got[0].blocked_reason is None and got[0].remaining == 4


def test_no_model(spark):
    rows = critic.states(spark.createDataFrame([(0, None)], "sheet_id long, text string")).collect()
    assert rows[0].reason in ("ocr_failed", "no_model")


def test_evidence_leaves_human_fields(spark):
    docs = spark.createDataFrame([(1, "Unidade: Norte\n07:30 porta")], "doc_id long, text string")
    fields = spark.createDataFrame([(1, 0, "Norte", "rule"), (1, 1, "Norte", "human"), (1, 2, "nada", "rule"), (1, 3, None, "rule")], "doc_id long, ord int, value string, source string")
    got = {r.ord: r for r in words.attach_evidence(fields, words.of_lines(docs)).collect()}
    assert got[0].evidence_method == "exact" and got[0].x0 == pytest.approx(0.05) and got[1].x0 is None and got[1].evidence_method is None and got[2].evidence_method == "none" and got[3].x0 is None
    assert words.attach_evidence(fields, None) is fields


def test_transcription_names_its_source(spark):
    pages = spark.createDataFrame([(1, 1, "b", 0.5, "s2"), (1, 0, "a", 0.9, "s1")], "doc_id long, page int, text string, confidence double, source string")
    r = words.transcribed(pages).first()
    assert (r.text, r.confidence, r.source) == ("a\n\f\nb", 0.5, "s1")


def test_config_file(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"routing": [[{"type": "theft"}, ["a"]], [{}, ["b"]]]}))
    assert config.load(str(tmp_path / "c.json"))["routing"][1] == ({}, ("b",))
    for bad in ({"routing": [[{"type": "nope"}, ["a"]], [{}, ["b"]]]}, {"other": 1}):
        (tmp_path / "c.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            config.load(str(tmp_path / "c.json"))


def test_persist_once(spark, tmp_path):
    path = str(tmp_path / "evidence.json")
    assert contracts.persist_once(spark, path, b"a") == "created" and contracts.persist_once(spark, path, b"a") == "verified"
    with pytest.raises(ValueError):
        contracts.persist_once(spark, path, b"b")
    assert (tmp_path / "evidence.json").read_bytes() == b"a" and len(list(tmp_path.iterdir())) <= 3


def test_canonical_sheet(spark):
    text = ['{"b":1,"a":{"z":"é","y":null},"source_file":"x"}', '{"a":1,"a":2}', "[1]", None]
    got = [r.c for r in spark.createDataFrame([(t,) for t in text], "t string").select(contracts.canonical_sheet(F.col("t")).alias("c")).collect()]
    assert got == ['{"a":{"y":null,"z":"é"},"b":1}', None, None, None]


def test_export_and_dataset(spark, tmp_path):
    kind = "sheet_id long, blockers array<string>, shown array<struct<pos:int,dia:string,unidade:string,objeto:string,descricao:string>>"
    sheets = spark.createDataFrame([(1, [], [(1, "=x", "u", "o", "d")]), (2, ["data_turno"], [(1, "x", "u", "o", "d")]), (3, [], [])], kind)
    shown, audit = contracts.export(sheets)
    assert {(r.sheet_id, r.action, r.detail) for r in audit.collect()} == {(1, "export_csv", "rows=1"), (2, "export_blocked", "pending: data_turno")}
    contracts.write_csv(shown.coalesce(1), str(tmp_path / "csv"))
    lines = next((tmp_path / "csv").glob("part-*")).read_text().splitlines()
    assert lines == ["DIA,UNIDADE,OBJETO,DESCRICAO", "'=x,u,o,d"]
    contracts.write_dataset(generate.canonical(spark, "smoke"), str(tmp_path / "set"))
    entries = spark.read.json(str(tmp_path / "set" / "manifests"))
    truths = {r.doc_id: r.gt_text for r in spark.read.json(str(tmp_path / "set" / "gt")).collect()}
    assert entries.count() == 50 and all(hashlib.sha256(truths[r.doc_id].encode()).hexdigest() == r.sha256_gt for r in entries.collect())
    with pytest.raises(Exception, match="exist"):
        contracts.write_dataset(generate.canonical(spark, "smoke"), str(tmp_path / "set"))


def test_corpora_follow_their_rules(spark):
    made = generate.canonical(spark, "stress")
    sheets, rows = made.collect(), generate.corpus_rows(made, 45).collect()
    splits = [r.split for r in sheets]
    assert [splits.count(s) for s in ("train", "val", "test")] == [700, 150, 150] and {r.split for r in sheets if r.template == "C"} == {"test"}
    shared, held = generate.vocabulary(generate.GUARDS)
    assert len(held) == 3 and not set(shared) & set(held)
    for r in sheets:
        names = r.guards.split(", ")
        assert len(set(names)) == len(names) and (r.split == "test" or not set(names) & set(held)) and (not r.struck or r.no_change) and (r.n_rows == 0) == r.no_change
    for r in rows:
        assert (r.entry is None) <= (r.exit is None) and "{" not in r.descricao
        if r.exit:
            minutes = lambda t: int(t[:2]) * 60 + int(t[3:])
            assert 10 <= (minutes(r.exit) - minutes(r.entry)) % 1440 <= 120
    names = generate.held_out(spark.createDataFrame([(f"n{i}",) for i in range(103)], "name string"))
    assert names.where("test_only").count() == 21 and names.count() == 103
    assert generate.held_out(spark.createDataFrame([("a",), ("b",)], "name string")).where("test_only").count() == 1
    assert generate.held_out(spark.createDataFrame([], "name string")).count() == 0


def near(found, of, percent):
    """Within four standard errors of a rate."""
    return abs(found / of - percent / 100) <= 4 * (percent / 100 * (1 - percent / 100) / of) ** 0.5


def test_rates_of_corpora_and_noise(spark):
    """Priors of sheets, days of the whole year, and each kind of noise at its rate where it can change something."""
    sheets = generate.corpus(spark.range(20_000).select(F.col("id").alias("sheet")), 45, "balanced").cache()
    heads = {r.sheet: r for r in generate.drawn_headers(sheets, 45).collect()}
    n = len(heads)
    share = lambda f, over=heads.values(): (sum(map(f, over)), len(over))
    quiet = [r for r in heads.values() if r.no_change]
    assert near(*share(lambda r: r.shift == "Dia"), 52) and near(len(quiet), n, 50) and near(*share(lambda r: r.struck, quiet), 25)
    busy = [r for r in heads.values() if not r.no_change]
    assert all(near(*share(lambda r: r.n_rows == k, busy), p) for k, p in ((1, 55), (2, 30), (3, 15)))
    assert all(near(*share(lambda r: r.guards.count(",") == k - 1), p) for k, p in ((1, 35), (2, 45), (3, 20)))
    days = {r.day for r in heads.values()}
    assert len(days) == 365 and min(days) == "2026-01-01" and max(days) == "2026-12-31" and near(*share(lambda r: r.day[-2:] in ("29", "30", "31")), 100 * 29 / 365)
    able = [r for r in heads.values() if any(w in r.unit for w in generate.ABBREVIATIONS)]
    assert near(*share(lambda r: r.unit != r.unit_text, able), 30) and all(r.guards == r.guards_text for r in heads.values())
    rows = generate.surface(generate.corpus_rows(sheets, 45), 45).collect()
    at = lambda kind, over=rows: (sum(kind in r.applied for r in over), len(over))
    assert near(*at("abbreviate:descricao", [r for r in rows if any(w in r.truth for w in generate.ABBREVIATIONS)]), 30)
    assert near(*at("partial:descricao"), 10) and near(*at("crossout:descricao"), 7) and near(*at("blank:acao"), 8)
    assert near(*at("ambiguous:hora", [r for r in rows if r.hora and any(c in r.hora for c in "01Ol")]), 15)
    # two equal letters side by side, and a time without a twin, stay as they are
    assert at("misspell:descricao")[0] <= 0.2 * len(rows) and near(sum(r.illegible for r in rows), len(rows), 5)
    assert {r.resolvido for r in rows} == {"sim", "não", None}
    assert len({(r.item, r.acao) for r in rows if r.acao}) == sum(len(b[2]) for b in generate.BANK)


def test_places_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(contracts, "ROWS_A_BUCKET", 50)
    rows = spark.range(1000).selectExpr("concat('d', id * 7919 % 1000) AS d", "id AS v").repartition(7, "v")
    got = {r.v: r.sheet for r in contracts.public(rows, ["v"], "d").collect()}
    order = sorted(range(1000), key=lambda i: f"d{i * 7919 % 1000}")
    assert got == {i: f"sheet_{k}" for k, i in enumerate(order, 1)}
    names = generate.held_out(spark.createDataFrame([(f"n{i}",) for i in range(730)], "name string"))
    want = sorted((hashlib.md5(f"n{i}7".encode()).hexdigest(), f"n{i}") for i in range(730))[:146]
    assert generate.corpus(spark.range(730).select(F.col("id").alias("sheet")), 1, "balanced").groupBy("split").count().orderBy("count").collect()[-1]["count"] == 510
    assert {r.name for r in names.where("test_only").collect()} == {n for _, n in want} and names.count() == 730


def test_publication_is_gated(spark, tmp_path):
    rows = spark.createDataFrame([(2, "clean", "x"), (1, "fine", "y")], "k long, note string, secret string")
    out = contracts.public(rows, ["note"], "k")
    contracts.publish(out, str(tmp_path / "ok"))
    assert {(r.sheet, r.note) for r in spark.read.json(str(tmp_path / "ok")).collect()} == {("sheet_1", "fine"), ("sheet_2", "clean")}
    for note, category in (("às 07:30", "clock-time"), ("em /home/ana/x", "local-home-path"), ("a@b.org", "e-mail"), ("Acme", "organization-sentinel"), ("o termo", "private-term")):
        with pytest.raises(ValueError, match=category):
            contracts.publish(out.withColumn("note", F.lit(note)), str(tmp_path / "no"), ["Termo"], ["acme"])
    assert not (tmp_path / "no").exists()


def test_folders_are_scanned(spark, tmp_path):
    (tmp_path / "private").mkdir()
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("ok\nàs 07:30 h")
    (tmp_path / "sub" / "b.py").write_text("t = '07:30'\np = '/home/ana/x'")
    (tmp_path / "private" / "c.md").write_text("às 07:30")
    (tmp_path / "d.png").write_bytes(b"07:30")
    got = {(r.id.rpartition("/")[2], r.line, r.category) for r in privacy.folder_findings(spark, str(tmp_path)).collect()}
    assert got == {("a.md", 2, "clock-time"), ("b.py", 2, "local-home-path")}


def test_verdict_is_given_once(spark):
    from tallyrook.operators import evaluate

    metrics = spark.createDataFrame([("a", 1.0)], "metric string, value double")
    earlier = spark.createDataFrame([("PASS",)], "verdict string")
    assert evaluate.verdict(metrics, [("a", ">=", 1.0)]).first().verdict == "PASS" and evaluate.verdict(metrics, [("b", ">=", 1.0)]).first().failed == "b"
    assert evaluate.verdict(metrics, [("a", ">=", 1.0)], earlier).first().verdict == "REFUSED" and evaluate.verdict(metrics, [("a", ">=", 1.0)], earlier.limit(0)).first().verdict == "PASS"


def test_gates_that_fail(spark):
    """Sheets whose signal is incomplete and invented incidents that nobody has to review fail the release."""
    from tallyrook.operators import evaluate

    good = {c: 0 for c in evaluate.FLAGS} | {"signal_complete": 4}
    cases = [({}, []), ({"signal_complete": 3}, ["completeness"]), ({"false_incident_unreviewed": 1}, ["false_incident_unreviewed"]), ({"unsafe_clean": 1, "unsafe_exportable": 2}, ["unsafe_clean", "unsafe_exportable"])]
    rows = [tuple({**good, **c}.values()) + (4, 1.0) for c, _ in cases]
    names = [f"{c}_count" for c in good] + ["n_ran", "safe_review_recall"]
    df = spark.createDataFrame(rows, names)
    got = [r.f for r in df.select(evaluate.gate_failures(df, F.lit(4), F.col("n_ran")).alias("f")).collect()]
    assert got == [f for _, f in cases]
    assert df.limit(1).select(evaluate.gate_failures(df, F.lit(5), F.col("n_ran")).alias("f")).first().f == ["coverage"]


def test_spread_keeps_places_and_drops_what_is_empty(spark):
    from tallyrook.functions.arrays import spread

    kind = "k int, xs array<struct<a:int,b:string>>"
    df = spark.createDataFrame([(1, [(5, "x"), (6, None)]), (2, []), (3, None), (4, [(None, None)])], kind)
    assert sorted(map(tuple, spread(df, "xs", "k", place="at").collect())) == [(1, 0, 5, "x"), (1, 1, 6, None), (4, 0, None, None)]
    plan = spread(df.withColumn("xs", F.transform("xs", lambda x: F.struct((x["a"] + 1).alias("a")))), "xs", "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan
