"""The same model in DuckDB SQL, for comparison: sheets, lines, regions, rows, header, states, fields."""

from __future__ import annotations

from ..config import HEADER_FIELDS, KEYWORDS
from ..functions.text import ACCENTED, MARKS, PLAIN, WHITE
from ..operators.critic import WORD, label_words

def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def fold(x: str) -> str:
    return f"lower(translate(regexp_replace({x}, '{MARKS}', '', 'g'), '{ACCENTED}', '{PLAIN}'))"


def norm(x: str) -> str:
    return strip(f"regexp_replace({fold(x)}, '{WHITE}+', ' ', 'g')")


def cer(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' THEN CASE WHEN {b} = '' THEN 0.0 ELSE 1.0 END ELSE levenshtein({a}, {b})::DOUBLE / length({a}) END)"


def matches(a: str, b: str) -> str:
    return f"coalesce({a} <> '' AND {b} <> '' AND {cer(norm(a), norm(b))} <= 0.5, false)"


_labels = " UNION ALL ".join(
    f"SELECT '{f}' AS field, {i} AS preference, '{x.rstrip(':').lower()}' AS label" for f, names in HEADER_FIELDS.items() for i, x in enumerate(names)
)
_kinds = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{label}'" for label, words in KEYWORDS)
_printed = ", ".join(f"'{w}'" for w in label_words())

ROWS = r"""sheet_rows AS (
  SELECT *, concat_ws(' ', entry, exit) AS truth_hora, l_partkey % 9 = 0 AS merged, concat_ws(' ', entry, CASE WHEN exit IS NOT NULL THEN 'saida' END, exit, regexp_replace(surface, '\[risc:([^\]]*)\]', '\1', 'g')) AS line FROM (
  SELECT *, CASE noise WHEN 'swap' THEN translate(truth_desc, 'aeo', 'eoa') WHEN 'partial' THEN substr(truth_desc, 1, (length(truth_desc) // 2)::INT)
    WHEN 'illegible' THEN '[ilegivel]' WHEN 'crossout' THEN '[risc:' || substr(truth_desc, 1, 4) || '] ' || truth_desc ELSE truth_desc END AS surface FROM (
  SELECT l_orderkey AS sheet_id, l_linenumber, l_partkey, l_suppkey, l_quantity::INT AS quantity,
    CASE l_partkey % 6 WHEN 0 THEN 'camera ' WHEN 1 THEN 'acesso ' WHEN 2 THEN 'furto ' WHEN 3 THEN 'alarme ' ELSE '' END || p_name || ' setor ' || l_suppkey AS truth_desc,
    lpad((l_partkey % 24)::VARCHAR, 2, '0') || ':' || lpad((l_suppkey % 60)::VARCHAR, 2, '0') AS entry,
    CASE WHEN l_partkey % 5 = 0 THEN lpad(((l_partkey + 1) % 24)::VARCHAR, 2, '0') || ':' || lpad((l_suppkey % 60)::VARCHAR, 2, '0') END AS exit,
    l_returnflag AS truth_item, CASE WHEN l_suppkey % 3 = 0 THEN 'equipe avisada' ELSE '' END AS truth_action, CASE l_linestatus WHEN 'F' THEN 'sim' ELSE '' END AS truth_resolved,
    CASE (l_partkey + l_suppkey) % 7 WHEN 1 THEN 'swap' WHEN 2 THEN 'partial' WHEN 3 THEN 'illegible' WHEN 4 THEN 'crossout' ELSE 'none' END AS noise
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'F')))"""

SHEETS = ROWS + r""",
bodies AS (SELECT sheet_id, count(*) AS n, string_agg(line || CASE WHEN l_partkey % 9 = 0 THEN chr(10) ELSE chr(10) || chr(10) END, '' ORDER BY l_linenumber, line, truth_desc, noise, quantity, truth_hora, merged) AS body
  FROM sheet_rows GROUP BY 1),
drawn AS (SELECT o_orderkey AS k, o_orderstatus, coalesce(n, 0) AS n, coalesce(body, '') AS body, n_name, strftime(o_orderdate, '%d/%m/%Y') AS day, c_name AS guard, 'Guarda ' || (o_orderkey % 17) AS other
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN bodies ON sheet_id = o_orderkey),
sheets AS (SELECT k AS sheet_id, 'Controle de ocorrencias' || chr(10)
  || CASE WHEN k % 13 = 0 THEN 'Data e Turno:' WHEN k % 11 = 0 THEN 'Data: ' || day ELSE 'Data e Turno: ' || day || CASE WHEN k % 2 = 0 THEN ' - Dia' ELSE ' - Noite' END END || chr(10)
  || 'Vigilantes: ' || CASE k % 4 WHEN 0 THEN guard WHEN 1 THEN guard || ', ' || other WHEN 2 THEN guard || ' e ' || other ELSE guard || ' / ' || other || '; Chefe' END || chr(10)
  || CASE WHEN k % 19 = 0 THEN 'Unidade:' ELSE 'Unidade: ' || n_name END || chr(10)
  || CASE WHEN k % 7 = 0 THEN '' ELSE 'Item Hora Descricao da Ocorrencia Acao Resolvido' || chr(10) END
  || CASE WHEN o_orderstatus = 'F' THEN CASE k % 3 WHEN 0 THEN 'S/A' || chr(10) WHEN 1 THEN '5/A' || chr(10) || chr(10) || 'S1A' || chr(10) ELSE ' s|a ' || chr(10) END ELSE body END
  || CASE WHEN k % 10 < 8 THEN 'Ronda: ok' || chr(10) || 'Monitoramento' || chr(10) ELSE '' END
  || CASE WHEN k % 23 = 0 THEN chr(12) || 'continua sem tabela' || chr(10) ELSE '' END AS text,
  day || CASE WHEN k % 11 = 0 THEN '' WHEN k % 2 = 0 THEN ' - Dia' ELSE ' - Noite' END AS truth_date,
  CASE k % 4 WHEN 0 THEN guard WHEN 1 THEN guard || ', ' || other WHEN 2 THEN guard || ' e ' || other ELSE guard || ' / ' || other || '; Chefe' END AS drawn_guards,
  CASE k % 4 WHEN 0 THEN guard WHEN 3 THEN guard || ', ' || other || ', Chefe' ELSE guard || ', ' || other END AS truth_guards, n_name AS truth_unit, n AS truth_n,
  CASE k % 5 WHEN 0 THEN 'clean' WHEN 1 THEN 'photo' WHEN 2 THEN 'photo' ELSE 'scan' END AS difficulty,
  CASE WHEN k % 20 >= 17 AND k % 4 = 0 THEN 'C' WHEN k % 2 = 0 THEN 'A' ELSE 'B' END AS template,
  CASE WHEN k % 20 < 14 THEN 'train' WHEN k % 20 < 17 THEN 'val' ELSE 'test' END AS split FROM drawn)"""

LINES = SHEETS + r""",
page_texts AS (SELECT sheet_id, p - 1 AS page, regexp_replace(string_split(text, chr(12))[p], '\n$', '') AS page_text FROM (SELECT *, unnest(range(1, len(string_split(text, chr(12))) + 1)) AS p FROM sheets)),
lines AS (SELECT sheet_id, page, i - 1 AS ln, string_split(page_text, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(page_text, chr(10))) + 1)) AS i FROM page_texts)),
heads AS (SELECT *, min(CASE WHEN regexp_matches(line, '(?i)^\s*[il]tem\b.*\bhora\b.*(?:descri|ocorr)') THEN ln END) OVER (PARTITION BY sheet_id, page) AS head FROM lines),
regions AS (SELECT *, min(CASE WHEN regexp_matches(line, '(?i)^\s*ronda(?:\s*[:\-]?\s*(?:x|ok))?\s*$') AND ln > head THEN ln END) OVER (PARTITION BY sheet_id, page) AS foot FROM heads)"""

SEGMENTS = LINES + rf""",
inside AS (SELECT sheet_id, page, ln, {strip("line")} AS t FROM regions WHERE ln > head AND ln < coalesce(foot, 2147483647)),
marked AS (SELECT *, regexp_matches(t, '(?i)^[S5]\s*[/|1lI]\s*A$') AS no_change FROM inside),
islands AS (SELECT *, sum((t = '' OR no_change)::INT) OVER (PARTITION BY sheet_id, page ORDER BY ln) AS island FROM marked),
joined AS (SELECT sheet_id, page, no_change, min(ln) AS ln, string_agg(t, ' ' ORDER BY ln) AS c FROM islands WHERE t <> '' GROUP BY sheet_id, page, island, no_change),
segments AS (SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY page, ln) AS pos, page, no_change, CASE WHEN NOT no_change THEN c END AS content,
  CASE WHEN NOT no_change THEN nullif(array_to_string(regexp_extract_all(c, '[0-9]{{1,2}}:[0-9]{{2}}'), ' '), '') END AS hora FROM joined)"""

HEADER = LINES + rf""",
labels_of AS ({_labels}),
candidates AS (SELECT sheet_id, page, ln, field, preference, {strip("line")} AS evidence,
  {strip("regexp_replace(substr(line, strpos(lower(line), label) + length(label)), '^[ :" + chr(92) + "t]+', '')")} AS value FROM lines JOIN labels_of ON contains(lower(line), label)),
header AS (SELECT sheet_id, field, value, evidence, page FROM candidates WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY sheet_id, field ORDER BY preference, page, ln) = 1)"""

MODELS = SEGMENTS + HEADER[len(LINES) :] + rf""",
models AS (SELECT s.*, coalesce(p.table_found, false) AS table_found, p.pages, coalesce(r.occurrences, 0) AS occurrences, coalesce(r.no_changes, 0) AS no_changes, h.data_turno, h.vigilantes, h.unidade,
  CASE WHEN coalesce(r.occurrences, 0) > 0 THEN 'present' WHEN NOT p.table_found THEN 'unknown' WHEN coalesce(r.no_changes, 0) > 0 THEN 'none' ELSE 'unknown' END AS disposition,
  list_filter(list_transform(string_split_regex(coalesce(nullif({strip("h.vigilantes")}, ''), ''), '\s*(?:,|;|\be\b|/)\s*'), lambda x: {strip("x")}), lambda x: x <> '') AS guards
  FROM sheets s LEFT JOIN (SELECT sheet_id, bool_and(head IS NOT NULL) AS table_found, max(page) + 1 AS pages FROM regions GROUP BY 1) p USING (sheet_id)
  LEFT JOIN (SELECT sheet_id, count_if(NOT no_change) AS occurrences, count_if(no_change) AS no_changes FROM segments GROUP BY 1) r USING (sheet_id)
  LEFT JOIN (SELECT sheet_id, max(CASE WHEN field = 'data_turno' THEN value END) AS data_turno, max(CASE WHEN field = 'vigilantes' THEN value END) AS vigilantes,
    max(CASE WHEN field = 'unidade' THEN value END) AS unidade FROM header GROUP BY 1) h USING (sheet_id))"""

FIELDS = MODELS + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY pos) AS i FROM segments WHERE NOT no_change),
fields AS (
  SELECT sheet_id, ord, name, value, CASE WHEN value IS NULL THEN 0.0 ELSE 0.65 END AS confidence, CASE WHEN value IS NULL THEN 'missing' ELSE 'must_review' END AS status, true AS must_review
  FROM (SELECT sheet_id, 0 AS ord, 'data_turno' AS name, data_turno AS value FROM models UNION ALL SELECT sheet_id, 1, 'vigilantes', vigilantes FROM models UNION ALL SELECT sheet_id, 2, 'unidade', unidade FROM models)
  UNION ALL SELECT sheet_id, 3, 'ocorrencias', CASE WHEN disposition = 'none' THEN '(sem alteração)' WHEN table_found THEN '(nenhuma linha legível)' ELSE '(tabela não encontrada no OCR)' END,
    CASE WHEN disposition = 'none' THEN 1.0 ELSE 0.0 END, CASE WHEN disposition = 'none' THEN 'accepted' ELSE 'must_review' END, disposition <> 'none' FROM models WHERE disposition <> 'present'
  UNION ALL SELECT sheet_id, 3 + 5 * (i - 1) + k, 'ocorrencia_' || i || '_' || suffix, CASE suffix WHEN 'objeto' THEN '(revisar)' WHEN 'hora' THEN hora WHEN 'descricao' THEN content END,
    CASE WHEN cell IS NULL THEN 0.0 ELSE 0.4 END, CASE WHEN cell IS NULL THEN 'missing' ELSE 'must_review' END, true
  FROM (SELECT *, CASE suffix WHEN 'hora' THEN hora WHEN 'descricao' THEN content END AS cell FROM numbered, (VALUES (0, 'objeto'), (1, 'hora'), (2, 'descricao'), (3, 'acao'), (4, 'resolvido')) AS v(k, suffix)))"""

_words = f"len(list_filter(regexp_extract_all(lower(text), '{WORD}'), lambda w: w NOT IN ({_printed})))"
STATES = FIELDS + rf""",
graded AS (SELECT *, CASE WHEN length({strip("text")}) < 30 THEN 'failed' WHEN disposition <> 'none' AND {_words} < 4 THEN 'failed' WHEN {_words} < 8 THEN 'low' ELSE 'good' END AS quality FROM models),
states AS (SELECT *, list_concat(list_filter([CASE WHEN pages > 1 THEN 'multipage' END, CASE WHEN quality = 'failed' THEN 'ocr_failed' END], lambda x: x IS NOT NULL), pending,
    CASE WHEN disposition = 'unknown' AND NOT list_contains(pending, 'ocorrencias') THEN ['ocorrencias'] ELSE [] END) AS blockers,
  CASE WHEN pages > 1 THEN 'multipage' WHEN quality = 'failed' THEN 'ocr_failed' WHEN len(pending) > 0 THEN 'pending' WHEN disposition = 'unknown' THEN 'unknown' END AS reason
  FROM (SELECT g.*, coalesce(w.pending, []) AS pending FROM graded g LEFT JOIN (SELECT sheet_id, list(name ORDER BY ord) AS pending FROM fields WHERE must_review GROUP BY 1) w USING (sheet_id)))"""

CLASSIFIED = STATES + rf""",
typed AS (SELECT *, CASE WHEN quality = 'failed' THEN 'unknown' WHEN {strip("text")} = '' THEN 'routine' {_kinds} ELSE 'other' END AS incident_type FROM states),
graded2 AS (SELECT *, CASE WHEN quality = 'failed' THEN 'unknown' ELSE CASE incident_type WHEN 'routine' THEN 'low' WHEN 'safety' THEN 'high' WHEN 'theft' THEN 'high' ELSE 'medium' END END AS urgency,
  CASE WHEN quality = 'failed' THEN 'manual_review' ELSE CASE incident_type WHEN 'equipment' THEN 'facilities' WHEN 'safety' THEN 'facilities' WHEN 'access_violation' THEN 'tech_security' WHEN 'theft' THEN 'tech_security' ELSE 'general_support' END END AS sector,
  CASE WHEN quality = 'failed' THEN 0.0 ELSE 0.6 END AS class_confidence FROM typed),
classified AS (SELECT *, CASE WHEN urgency = 'critical' THEN 'tech_security_oncall,general_support' WHEN incident_type = 'theft' THEN 'tech_security,general_support'
  WHEN incident_type = 'equipment' THEN 'facilities' WHEN incident_type = 'access_violation' THEN 'tech_security' ELSE 'general_support' END AS recipients FROM graded2)"""

_entry = f"coalesce(nullif(regexp_extract(nullif({strip('hora')}, ''), '[0-9]{{1,2}}:[0-9]{{2}}'), ''), nullif({strip('hora')}, ''))"
_exit = f"regexp_extract_all(nullif({strip('hora')}, ''), '[0-9]{{1,2}}:[0-9]{{2}}')[2]"
SPREADSHEET = STATES + rf""",
timed AS (SELECT sheet_id, pos, content, hora, {_entry} AS entry_time, {_exit} AS exit_time FROM segments WHERE NOT no_change),
described AS (SELECT *, CASE WHEN entry_time IS NULL THEN coalesce(content, '') ELSE concat_ws('-', entry_time, exit_time) || CASE WHEN coalesce(content, '') <> '' THEN ' - ' || content ELSE '' END END AS descricao FROM timed),
spreadsheet AS (SELECT s.sheet_id, coalesce(pos, 0) AS pos, coalesce(data_turno, '(revisar)') AS dia, coalesce(unidade, '(revisar)') AS unidade,
  CASE disposition WHEN 'unknown' THEN '(ocorrências não confirmadas)' WHEN 'none' THEN 'Sem alteração' ELSE '(revisar)' END AS objeto, coalesce(descricao, '') AS descricao
  FROM states s LEFT JOIN described d USING (sheet_id))"""
