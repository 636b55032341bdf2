"""Extraction, normalisation, critic, classes, routes and outputs on sheets written out by hand."""

import pytest
from pyspark.sql import functions as F

from tallyrook import config
from tallyrook.functions import text as X
from tallyrook.operators import classify, critic, extract, outputs

HEAD = "Controle\nData e Turno: 01/02/2026 - Dia\nVigilantes: Ana, Bruno e Carlos\nUnidade: Norte\n"
COLUMNS = "Item Hora Descrição Ação Resolvido\n"


def sheets(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "sheet_id long, text string")


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize(
    "body, disposition, n",
    [
        (COLUMNS + "S/A\n\n5/A\nS1A\nRonda\n", "none", 0),
        (COLUMNS + "07:30 porta aberta\ndo setor dois\n\n08:00 camera\nRonda: ok\n", "present", 2),
        (COLUMNS + "Ronda\n", "unknown", 0),
        ("07:30 sem cabecalho\n", "unknown", 0),
        (COLUMNS + "S/A\n09:10 algo visto\n", "present", 1),
        (COLUMNS + "S/A\n\fpagina sem tabela\n", "unknown", 0),
        (COLUMNS + "a ronda passou pelo portao\nRonda x\nfora\n", "present", 1),
    ],
)
def test_disposition(spark, body, disposition, n):
    row = one(extract.models(sheets(spark, HEAD + body)))
    assert (row.disposition, row.occurrences) == (disposition, n)


def test_rows_join_and_times(spark):
    rows = extract.segments(sheets(spark, HEAD + COLUMNS + "  07:30 porta\n saida 08:05 fim \n\nsem hora\n")).orderBy("pos").collect()
    assert [(r.content, r.hora) for r in rows] == [("07:30 porta saida 08:05 fim", "07:30 08:05"), ("sem hora", None)]
    times = one(spark.createDataFrame([("07:30 08:05", "cedo", None)], "a string, b string, c string").select(extract.entry_time(F.col("a")).alias("a"), extract.exit_time(F.col("a")).alias("x"), extract.entry_time(F.col("b")).alias("b"), extract.entry_time(F.col("c")).alias("c")))
    assert tuple(times) == ("07:30", "08:05", "cedo", None)


def test_header_prefers_labels_then_pages(spark):
    found = {r.field: r for r in extract.header(sheets(spark, "Data: x\nData e Turno:\n\fdata e turno - \t 05/05/2026\nComunidade Sul")).collect()}
    assert found["data_turno"].value == "- \t 05/05/2026" and found["data_turno"].page == 1
    assert found["unidade"].value == "Sul" and "vigilantes" not in found


def test_guards_and_resolved(spark):
    row = one(spark.createDataFrame([("Ana, Bruno e Carlos/ Davi ;;", "Não", "talvez")], "g string, a string, b string").select(extract.guards(F.col("g")).alias("g"), extract.resolved(F.col("a")).alias("a"), extract.resolved(F.col("b")).alias("b")))
    assert row.g == ["Ana", "Bruno", "Carlos", "Davi"] and row.a is False and row.b is None


def test_critic_flags_every_cell(spark):
    base = sheets(spark, HEAD + COLUMNS + "07:30 porta aberta\n", HEAD + COLUMNS + "S/A\n", "curto")
    fields = critic.fields(base)
    first = {r.name: r for r in fields.where("sheet_id = 0").collect()}
    assert len(first) == 8 and first["ocorrencia_1_acao"].status == "missing" and first["ocorrencia_1_hora"].value == "07:30" and all(r.must_review for r in first.values())
    last = [r.name for r in fields.where("sheet_id = 1 and not must_review").collect()]
    assert last == ["ocorrencias"]
    states = {r.sheet_id: r for r in critic.states(base).collect()}
    assert states[2].quality == "failed" and states[2].reason == "ocr_failed" and states[2].blockers[0] == "ocr_failed" and states[0].reason == "pending"


def test_classes_and_routes(spark):
    rows = spark.createDataFrame([("um furto de camera",), ("CRACHÁ perdido",), ("  ",), ("nada",), ("alarme",)], "t string")
    got = [r.x for r in rows.select(classify.incident_type(F.col("t")).alias("x")).collect()]
    assert got == ["theft", "access_violation", "routine", "other", "safety"]
    to = spark.createDataFrame([("theft", "critical", "x"), ("theft", "high", "x"), ("equipment", "medium", "x"), ("other", "low", "x")], "k string, u string, s string").select(classify.recipients(F.col("k"), F.col("u"), F.col("s")).alias("r")).collect()
    assert [r.r[0] for r in to] == ["tech_security_oncall", "tech_security", "facilities", "general_support"]


def test_config_is_checked():
    config.check()
    with pytest.raises(ValueError):
        config.check(routing=(({"type": "theft"}, ("a",)),))
    with pytest.raises(ValueError):
        config.check(routing=(({"type": "nope"}, ("a",)), ({}, ("b",))))
    assert len(config.fingerprint()) == 64


def test_outputs(spark):
    base = sheets(spark, HEAD + COLUMNS + "07:30 porta\n", HEAD + COLUMNS + "S/A\n", HEAD + "nada mais aqui para ler hoje em dia")
    states = critic.states(base)
    rows = {r.sheet_id: r for r in outputs.spreadsheet(states).collect()}
    assert rows[0].descricao == "07:30 - 07:30 porta" and rows[1].objeto == "Sem alteração" and rows[2].objeto == "(ocorrências não confirmadas)"
    message = {r.sheet_id: r.message for r in outputs.messages(states).collect()}
    assert message[1].startswith("RASCUNHO INCOMPLETO") and message[1].endswith("Vigilantes: Ana, Bruno, Carlos")


@pytest.mark.parametrize("a, b, want", [("kitten", "sitting", 3 / 6), ("", "x", 1.0), ("", "", 0.0), ("hello", "hallo", 0.2)])
def test_cer(spark, a, b, want):
    assert one(spark.createDataFrame([(a, b)], "a string, b string").select(X.cer(F.col("a"), F.col("b")).alias("x"))).x == pytest.approx(want)


def test_text_functions(spark):
    rows = spark.createDataFrame([("\t Ação  É\n",), ("=1",), (" x",), ("ok",), ("​z",)], "t string")
    got = rows.select(X.norm(F.col("t")).alias("n"), X.csv_safe(F.col("t")).alias("c"), X.tokens(F.col("t")).alias("k")).collect()
    assert got[0].n == "acao e" and [r.c[0] == "'" for r in got] == [True, True, True, False, True] and got[0].k == ["acao", "e"]
    assert rows.select(X.norm(F.lit("\u00a0x\u2003")).alias("n")).first().n == "x"
    assert rows.select(X.fold(F.lit("ŁódŹ Ǆ ẽe\u0301 Ő")).alias("n")).first().n == "łódz ǆ ee o".replace("ó", "o")


@pytest.mark.parametrize("a, b, want", [("a b c", "a x c d", 2 / 3), ("", "", 0.0), ("", "x", 1.0), ("x", "", 1.0), ("um dois", "dois um", 1.0), ("á á b", "á b", 1 / 3)])
def test_wer(spark, a, b, want):
    assert one(spark.createDataFrame([(a, b)], "a string, b string").select(X.wer(F.col("a"), F.col("b")).alias("x"))).x == pytest.approx(want)


def test_lines_end_as_in_python(spark):
    text = "a\x1cb\x85c\u2028d\r\ne\vf\n"
    assert [r.line for r in extract.lines(sheets(spark, text)).orderBy("ln").collect()] == text.splitlines()
