"""The report's configuration: fields, labels, rules. Validated here, compiled to columns by the operators."""

from __future__ import annotations

import hashlib
import json

# Fixed values of the report format: field names with the printed labels that precede their values, in order of preference.
HEADER_FIELDS: dict[str, tuple[str, ...]] = {
    "data_turno": ("Data e Turno", "Data e Turno:", "Data"),
    "vigilantes": ("Vigilantes", "Vigilantes:", "Vigilante"),
    "unidade": ("Unidade", "Unidade:"),
}
COLUMN_LABELS: dict[str, tuple[str, ...]] = {
    "item": ("Item",),
    "hora": ("Hora",),
    "descricao": ("Descrição da Ocorrência", "Descrição", "Descricao"),
    "acao": ("Ação", "Acao"),
    "resolvido": ("Resolvido (sim/não)", "Resolvido"),
}
# Words printed on the form, which say nothing about the handwriting. They are used as a set of words, each written once.
FORM_WORDS = (
    "controle de ocorrencias ocorrências ronda monitoramento cameras câmeras acesso pessoas cargas revista veiculos veículos "
    "outros sim nao não item hora descricao descrição ocorrencia ocorrência acao ação resolvido data turno vigilantes vigilante unidade"
)
# Keywords of each incident type; the first type with one in the text wins.
KEYWORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("theft", ("furto", "subtracao", "subtração")),
    ("access_violation", ("acesso", "cracha", "crachá")),
    ("safety", ("incendio", "incêndio", "alarme", "vazamento", "risco")),
    ("equipment", ("equip", "camera", "câmera", "portao", "portão", "monit")),
    ("other", ("diversa", "atipica", "atípica", "complementar")),
)
URGENCY = {"routine": "low", "equipment": "medium", "access_violation": "medium", "safety": "high", "theft": "high", "other": "medium"}
SECTOR = {
    "routine": "general_support", "equipment": "facilities", "access_violation": "tech_security",
    "safety": "facilities", "theft": "tech_security", "other": "general_support",
}
TAXONOMY = {
    "type": ("routine", "access_violation", "equipment", "safety", "theft", "other"),
    "urgency": ("low", "medium", "high", "critical"),
    "sector": ("tech_security", "general_support", "facilities"),
}
# Routing rules in order; the last has no condition.
ROUTING: tuple[tuple[dict[str, str], tuple[str, ...]], ...] = (
    ({"urgency": "critical"}, ("tech_security_oncall", "general_support")),
    ({"type": "theft"}, ("tech_security", "general_support")),
    ({"type": "equipment"}, ("facilities",)),
    ({"type": "access_violation"}, ("tech_security",)),
    ({}, ("general_support",)),
)
# Thresholds of the critic and the reading-quality gate, and confidences of rule-read cells.
REVIEW_BELOW = 0.70
HEADER_CONFIDENCE, ROW_CONFIDENCE, CLASSIFY_CONFIDENCE = 0.65, 0.40, 0.60
LEAST_CHARS, LEAST_WORDS, GOOD_WORDS = 30, 4, 8
CER_FAIL = 0.5


def check(routing=ROUTING, taxonomy=TAXONOMY) -> None:
    """Fail before any plan is built: exactly one default rule, at the end, and only known labels."""
    if [i for i, (when, _) in enumerate(routing) if not when] != [len(routing) - 1]:
        raise ValueError("exactly one routing rule without a condition is needed, as the last")
    for when, _ in routing:
        for dimension, label in when.items():
            if label not in taxonomy.get(dimension, ()):
                raise ValueError(f"unknown label {dimension}={label}")


REPORT_TYPE = "controle_ocorrencias"


def load(path: str) -> dict:
    """Routing and taxonomy of a JSON file, checked; what the file doesn't name stays as it is here."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    unknown = set(given) - {"routing", "taxonomy"}
    if unknown:
        raise ValueError(f"unknown settings {', '.join(sorted(unknown))}")
    taxonomy = {k: tuple(v) for k, v in given.get("taxonomy", TAXONOMY).items()}
    routing = tuple((dict(when), tuple(to)) for when, to in given.get("routing", ROUTING))
    check(routing, taxonomy)
    return {"routing": routing, "taxonomy": taxonomy}


def compatible(report_type, config_sha):
    """A column: whether a draft was made under this report and exactly this configuration."""
    return (report_type == REPORT_TYPE) & (config_sha == fingerprint())


def fingerprint() -> str:
    """The configuration's identity: sha256 of its canonical JSON."""
    whole = {"fields": HEADER_FIELDS, "columns": COLUMN_LABELS, "keywords": KEYWORDS, "taxonomy": TAXONOMY, "routing": ROUTING}
    return hashlib.sha256(json.dumps(whole, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
