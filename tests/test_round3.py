"""Faults that a review found: plans that held large texts, places looked for by joins."""

from pyspark.sql import functions as F

from tallyrook.operators import evaluate, terms, words
from tallyrook.plans import data_queries


def test_ratio_in_the_row_is_that_of_the_places(spark):
    values = [(1, ["Guarda 7", None, "(revisar)", "Ronda ÓK", "fora"], "x Guarda\n ronda:\t OK\fsegunda fora"), (2, [], "a b"), (3, ["b!"], None), (4, ["-", "b"], "a B\n")]
    df = spark.createDataFrame(values, "sheet_id long, v array<string>, text string")
    df = df.withColumn("f", F.transform("v", lambda v, i: F.struct(i.alias("ord"), v.alias("value"), (i != 4).alias("must_review"))))
    fields = df.select(F.col("sheet_id").alias("doc_id"), F.inline("f"))
    places = words.attach_evidence(fields, words.of_lines(df.select(F.col("sheet_id").alias("doc_id"), "text")))
    want = {r.sheet_id: r.repairable_ratio for r in evaluate.repairable(places.withColumnRenamed("doc_id", "sheet_id")).collect()}
    got = evaluate.repairable_in_row(df, F.col("f"))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.sheet_id: r.repairable_ratio for r in got.collect()} == {1: 0.5, 2: None, 3: 0.0, 4: 0.5} == {2: None, **want}


def test_plan_holds_no_large_text(spark, sf):
    plan = data_queries.QUERIES["strict_json_events"](spark, sf)._jdf.queryExecution()
    for node in (plan.optimizedPlan(), plan.executedPlan()):
        assert "z" * 1000 not in node.toString()


def test_pieces_of_characters(spark):
    df = spark.createDataFrame([("a🙂bcab🙂\nbc",), ("abc",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(terms._grams(F.col("t"), 4)).collect()] == [["a🙂bc", "🙂bca", "bcab", "cab🙂", "ab🙂\n", "b🙂\nb", "🙂\nbc"], [], [], None]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_of_a_table_are_applied_once(spark, sf):
    """F6 to F23: inside a lambda Spark computes every mention anew, so each is written once."""
    from tallyrook.operators import classify, critic, extract
    from tallyrook.sources.sheets import sheets

    plan = _plan(classify.classified(critic.states(sheets(spark, sf))).select("rows", "incident_type", "quality"))
    assert plan.count("[il]tem") == 1 and plan.count("ronda(?:") == 1 and plan.count("lower(") <= 2
    assert plan.count(critic.LOW_WORD) == 1 and plan.count(extract.CLOCK) == 1


def test_marks_in_a_text_are_no_rows(spark):
    from tallyrook.operators import extract

    df = spark.createDataFrame([(1, "Item Hora Descricao\n\x02\nfim\n\na\x01b\n S/A\r\n\x1f　7:05 c \x85 \nd\nRonda")], "sheet_id long, text string")
    rows = [(r.no_change, r.content, r.hora) for r in extract.segments(df).orderBy("pos").collect()]
    assert rows == [(False, "\x02 fim", None), (False, "a\x01b", None), (True, None, None), (False, "7:05 c", "7:05"), (False, "d", None)]


def test_header_text_is_that_of_the_lines(spark):
    from tallyrook.config import HEADER_FIELDS
    from tallyrook.operators import extract

    texts = ["Data: x\nData e Turno:\n\fDATA e turno - \t 5/5\nComunidade Sul", "unidade\r\nUnidade :　\nunidade unidade z \x85vigilante\x0bVigilantes:: A, B ", "data", "", None]
    df = extract.with_lines(extract.parsed(spark.createDataFrame(list(enumerate(texts)), "sheet_id long, text string")))
    for labels in (*HEADER_FIELDS.values(), ("Ação",), ("K",)):
        for r in df.select(extract.header_text(labels).alias("a"), extract.header_value(labels)["value"].alias("b")).collect():
            assert r.a == r.b
    assert df.where("sheet_id = 0").select(extract.header_text(("Data e Turno", "Data"))).first()[0] == "- \t 5/5"


def test_waiting_names_are_those_of_the_fields(spark, sf):
    from tallyrook.operators import critic, edits, extract
    from tallyrook.sources.sheets import sheets

    found = extract.models(sheets(spark, sf))
    names = lambda fields: F.transform(F.filter(fields, lambda f: f["must_review"]), lambda f: f["name"])
    assert found.where(~critic.pending(found).eqNullSafe(names(critic.field_list(found)))).count() == 0
    rows = "array<struct<category:string,entry_time:string,exit_time:string,description:string,action:string,resolved:boolean>>"
    values = [("a", ["g"], None, [(None, None, None, "d", None, True), ("c", "1", None, None, None, None), ("c", None, None, "d", None, None)]), (None, [], "u", []), ("a", [""], "u", [(None,) * 6])]
    df = spark.createDataFrame(values, f"new_date string, new_guards array<string>, new_unit string, edited_rows {rows}").withColumn("table_found", F.lit(True))
    for now in ("none", "unknown", "present"):
        assert df.where(~edits.reviewed_pending(F.lit(now)).eqNullSafe(names(edits.reviewed_fields(F.lit(now))))).count() == 0


def test_distances_are_counted_once(spark, sf):
    from tallyrook.operators import evaluate as E

    plan = _plan(E.scored(E.base_of(spark, sf)).select("effort", "lines"))
    assert plan.count("levenshtein(") == 3
    pairs = spark.createDataFrame([("abcd", "abxx", True), ("abcd", "axxx", False), ("abc", "ab", True), ("abc", "a", False), ("a", "a", True), ("a", "b", False), ("", "", False), ("a", "", False)], "a string, b string, w boolean")
    assert pairs.where(E._close(F.col("a"), F.col("b")) != F.col("w")).count() == 0
