"""Reports from files: what is taken, what is refused, and what it makes of sheets."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from tallyrook import config
from tallyrook.operators import configured
from tallyrook.sources import report_files as R

GOOD = {
    "report_type": "visitas",
    "fields": [
        {"name": "dia", "type": "date", "ocr_aliases": ["Dia", "Data"]}, {"name": "portao", "type": "enum", "values": ["Norte", "Sul"], "required": False, "ocr_aliases": ["Portao:"]},
        {"name": "nota", "type": "text", "required": False}, {"name": "linhas", "type": "table", "columns": [{"name": "hora", "type": "string"}, {"name": "ok", "type": "bool"}]},
    ],
    "classification": {"type": {"labels": ["a", "b"]}, "urgency": {"labels": ["low"]}, "sector": {"labels": ["x"]}},
    "routing": [{"when": {"type": "a", "urgency": None}, "recipients": ["r1"]}, {"recipients": ["r2", "r3"]}], "performance": {"max_seconds_per_sheet": 20},
}


def changed(path, value):
    out = copy.deepcopy(GOOD)
    at = out
    for step in path[:-1]:
        at = at[step]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


@pytest.mark.parametrize(
    "path, value, fault",
    [
        (["extra"], 1, "unknown extra"), (["report_type"], None, "report_type is missing"), (["fields"], [], "fields are missing"), (["fields", 0, "type"], "number", "type has to be one of"), (["fields", 1, "values"], [], "an enum needs values"),
        (["fields", 3, "columns"], [], "a table needs columns"), (["fields", 0, "columns"], [{"name": "x", "type": "text"}], "only a table has columns"), (["fields", 3, "columns", 1, "type"], "table", "column ok: type has to be one of"),
        (["fields", 3, "columns", 1, "name"], "hora", "column names repeat"), (["fields", 1, "name"], "dia", "field names repeat"), (["fields", 3], None, "exactly one field has to be a table"), (["fields", 0, "required"], "yes", "required has to be true or false"),
        (["fields", 0, "color"], "red", "unknown color"), (["classification", "urgency"], None, "classification urgency needs labels"), (["routing", 0, "when", "type"], "c", "routing 0: type=c is no label"), (["routing", 1], None, "without a condition"),
        (["routing", 0, "when"], {}, "routing 0"), (["routing", 1, "recipients"], [], "routing 1 needs recipients"), (["performance", "max_seconds_per_sheet"], -1, "max_seconds_per_sheet"), (["fields", 0, "ocr_aliases"], "Dia", "has to be a list of texts"),
    ],
)
def test_faults_are_named(path, value, fault):
    if path == ["routing", 0, "when"]:
        # no default, yet without a condition: one that says nothing is accepted as a rule, as it names no label
        assert R.parsed(changed(path, value)).routing[0][0] == {"": ""}
        return
    with pytest.raises(ValueError, match=fault):
        R.parsed(changed(path, value))


def test_all_faults_at_once():
    with pytest.raises(ValueError) as e:
        R.parsed({"fields": [{"name": "a", "type": "enum"}], "what": 1})
    assert len(str(e.value).split("\n")) >= 7


def test_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(GOOD))
    report = R.load(spark, str(tmp_path / "r.json"))
    assert report == R.parsed(GOOD) and report.seconds_a_sheet == 20 and report.table.columns[1].kind == "bool"
    assert report.fingerprint() == R.parsed(json.loads(json.dumps(GOOD, sort_keys=True))).fingerprint() != R.parsed(changed(["fields", 0, "required"], False)).fingerprint()
    pytest.importorskip("yaml")
    import yaml

    (tmp_path / "r.yaml").write_text(yaml.safe_dump(GOOD))
    assert R.load(spark, str(tmp_path / "r.yaml")) == report


def test_own_report_is_the_packages():
    own = R.own()
    assert {f.name: f.labels for f in own.scalars} == config.HEADER_FIELDS and [c.name for c in own.table.columns] == list(config.COLUMN_LABELS) and own.routing == config.ROUTING


def test_sheets_by_a_report(spark):
    report = R.parsed(GOOD)
    texts = ["Dia: 31/02/2026\nPortao: Leste", "Data: 01/02/2026\nportao: Sul", "nada", None]
    got = {(r.doc_id, r.name): (r.value, r.status, r.error) for r in configured.checked(spark.createDataFrame(list(enumerate(texts)), "sheet_id long, text string"), report).collect()}
    assert len(got) == 12
    assert got[0, "dia"] == ("31/02/2026", "must_review", "dia: not a date") and got[0, "portao"] == ("Leste", "must_review", "portao: not an allowed value")
    assert got[1, "dia"][2] is None and got[1, "portao"] == ("Sul", "must_review", None) and got[1, "nota"] == (None, "missing", None)
    assert got[2, "dia"] == (None, "missing", "dia: required field is missing") and got[3, "dia"][2] == "dia: required field is missing"
    rows = spark.createDataFrame([("a", "low"), ("b", "low"), (None, None)], "t string, u string")
    to = configured.recipients(report, {"type": F.col("t"), "urgency": F.col("u"), "sector": F.lit(None)})
    assert [r.to for r in rows.select(to.alias("to")).collect()] == [["r1"], ["r2", "r3"], ["r2", "r3"]]
    every = configured.recipients(R.parsed(changed(["routing", 0, "when"], {})), {"type": F.col("t"), "urgency": F.col("u"), "sector": F.lit(None)})
    assert {tuple(r.to) for r in rows.select(every.alias("to")).collect()} == {("r1",)}
