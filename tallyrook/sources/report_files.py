"""A report's configuration from a file: its fields and table columns, labels, taxonomy, routing and limits. Everything is checked, and all
faults are named at once, before any plan is built; operators.configured compiles a report to columns."""

from __future__ import annotations

import hashlib
import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .. import config

# Kinds of fields, what a report may say, and its limits where it says nothing.
SCALARS, TABLE = ("date", "string", "enum", "bool", "text"), "table"
KEYS = ("report_type", "fields", "classification", "routing", "performance")
FIELD_KEYS = ("name", "type", "required", "handwritten", "values", "ocr_aliases", "columns")
DIMENSIONS = ("type", "urgency", "sector")
SECONDS_A_SHEET = 300
SPEC = "name string, kind string, required boolean, allowed array<string>"


class Field(NamedTuple):
    name: str
    kind: str
    required: bool = True
    handwritten: bool = True
    values: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    columns: tuple[Field, ...] = ()


class Report(NamedTuple):
    report_type: str
    fields: tuple[Field, ...]
    taxonomy: dict[str, tuple[str, ...]]
    routing: tuple[tuple[dict[str, str], tuple[str, ...]], ...]
    seconds_a_sheet: int = SECONDS_A_SHEET

    @property
    def scalars(self) -> tuple[Field, ...]:
        return tuple(f for f in self.fields if f.kind != TABLE)

    @property
    def table(self) -> Field:
        return next(f for f in self.fields if f.kind == TABLE)

    def spec(self, spark: SparkSession) -> DataFrame:
        """The scalar fields as operators.critic.scalar_fields() wants them; as many rows as the report has fields."""
        return spark.createDataFrame([(f.name, f.kind, f.required, list(f.values)) for f in self.scalars], SPEC)

    def fingerprint(self) -> str:
        """The content's identity, whatever the file's form: sha256 of its canonical JSON."""
        return hashlib.sha256(json.dumps(self, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def _texts(given, where: str, faults: list[str]) -> tuple[str, ...]:
    if given is None:
        return ()
    if not isinstance(given, list) or not all(isinstance(x, str) for x in given):
        faults.append(f"{where} has to be a list of texts")
        return ()
    return tuple(given)


def _field(given, where: str, faults: list[str], column: bool = False) -> Field:
    if not isinstance(given, dict) or not isinstance(given.get("name"), str) or not given["name"]:
        faults.append(f"{where} has to have a name")
        return Field("", "string")
    where, kind = f"{where} {given['name']}", given.get("type")
    kinds = SCALARS if column else (*SCALARS, TABLE)
    if kind not in kinds:
        faults.append(f"{where}: type has to be one of {', '.join(kinds)}")
    for key in sorted(set(given) - set(FIELD_KEYS)):
        faults.append(f"{where}: unknown {key}")
    for key in ("required", "handwritten"):
        if not isinstance(given.get(key, True), bool):
            faults.append(f"{where}: {key} has to be true or false")
    values, labels = (_texts(given.get(k), f"{where}: {k}", faults) for k in ("values", "ocr_aliases"))
    if kind == "enum" and not values:
        faults.append(f"{where}: an enum needs values")
    columns = given.get("columns")
    if (kind == TABLE) != bool(columns):
        faults.append(f"{where}: a table needs columns" if kind == TABLE else f"{where}: only a table has columns")
    inner = tuple(_field(c, f"{where}: column", faults, column=True) for c in columns or [])
    if len({c.name for c in inner}) < len(inner):
        faults.append(f"{where}: column names repeat")
    return Field(given["name"], str(kind), given.get("required", True) is True, given.get("handwritten", True) is True, values, labels, inner)


def parsed(given) -> Report:
    """A report of what a file holds; a ValueError names every fault, one a line."""
    faults: list[str] = []
    if not isinstance(given, dict):
        raise ValueError("a report has to be an object")
    faults += [f"unknown {key}" for key in sorted(set(given) - set(KEYS))]
    if not isinstance(given.get("report_type"), str) or not given["report_type"]:
        faults.append("report_type is missing")
    listed = given.get("fields") if isinstance(given.get("fields"), list) else []
    if not listed:
        faults.append("fields are missing")
    fields = tuple(_field(f, "field", faults) for f in listed)
    if len({f.name for f in fields}) < len(fields):
        faults.append("field names repeat")
    if listed and sum(f.kind == TABLE for f in fields) != 1:
        faults.append("exactly one field has to be a table")
    classes = given.get("classification") if isinstance(given.get("classification"), dict) else {}
    taxonomy = {}
    for dimension in DIMENSIONS:
        inner = classes.get(dimension)
        labels = _texts(inner.get("labels") if isinstance(inner, dict) else None, f"classification {dimension}", faults)
        if not labels:
            faults.append(f"classification {dimension} needs labels")
        taxonomy[dimension] = labels
    routing = []
    for i, rule in enumerate(given.get("routing") if isinstance(given.get("routing"), list) else []):
        rule = rule if isinstance(rule, dict) else {}
        when = {k: v for k, v in (rule.get("when") or {}).items() if v is not None}
        to = _texts(rule.get("recipients"), f"routing {i}", faults)
        if not to:
            faults.append(f"routing {i} needs recipients")
        faults += [f"routing {i}: {k}={v} is no label" for k, v in when.items() if v not in taxonomy.get(k, ())]
        # a rule that says when but nothing of it fits everything, yet is no default
        routing.append((when if when or rule.get("when") is None else {"": ""}, to))
    if [i for i, (when, _) in enumerate(routing) if not when] != [len(routing) - 1]:
        faults.append("exactly one routing rule without a condition is needed, as the last")
    performance = given.get("performance") or {}
    seconds = performance.get("max_seconds_per_sheet", SECONDS_A_SHEET) if isinstance(performance, dict) else None
    if not isinstance(seconds, int) or isinstance(seconds, bool) or seconds <= 0:
        faults.append("performance: max_seconds_per_sheet has to be a whole number above 0")
    if faults:
        raise ValueError("\n".join(faults))
    return Report(given["report_type"], fields, taxonomy, tuple(routing), seconds)


def load(spark: SparkSession, path: str) -> Report:
    """The report of a file in any store: JSON, or YAML by its suffix where its parser is installed."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML can't be read here; give the report as JSON") from e
        return parsed(yaml.safe_load(text))
    return parsed(json.loads(text))


def own() -> Report:
    """The report that this package is written for."""
    head = tuple(Field(n, "string", True, True, (), labels) for n, labels in config.HEADER_FIELDS.items())
    kinds = {"descricao": ("text", ()), "resolvido": ("enum", ("sim", "nao"))}
    columns = tuple(Field(n, kinds.get(n, ("string", ()))[0], True, True, kinds.get(n, ("string", ()))[1], labels) for n, labels in config.COLUMN_LABELS.items())
    return Report(config.REPORT_TYPE, (*head, Field("ocorrencias", TABLE, False, columns=columns)), dict(config.TAXONOMY), config.ROUTING)
