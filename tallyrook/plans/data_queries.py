"""Queries on generation, surface noise, manifests, canonical forms and what may be published."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts, extract, forms, generate as G, manifest
from ..sources import json_sheets
from ..sources.sheets import sheet_rows, table
from . import base_sql as B

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Corpora of one sheet an order. Their SQL states priors, rates and spans by itself; names and templates are tables, and numbers follow
# the one formula of G.number.
def _values(rows) -> str:
    text = lambda x: "'" + x + "'" if isinstance(x, str) else "[" + ", ".join(map(text, x)) + "]" if isinstance(x, list) else str(x)
    return "VALUES " + ", ".join("(" + ", ".join([str(i), *map(text, r)]) + ")" for i, r in enumerate(rows))


def _corpus(seed: int, no_change: int) -> str:
    num = lambda salt, below=100: G.number("sheet", seed, salt, below)
    held = lambda t, n: f"SELECT *, row_number() OVER (ORDER BY (i * 7919 + 7 * 104729) % 1000003 * 31 % 9973, i) <= {n} AS held FROM {t}"
    lists = lambda c, t, n: f"(SELECT list({c} ORDER BY held, i) AS every, list({c} ORDER BY i) FILTER (NOT held) AS shared FROM ({held(t, n)}))"
    guard = lambda i: f"CASE WHEN split = 'test' THEN g.every[({num(5, 1000)} + {i} * 7) % 15 + 1] ELSE g.shared[({num(5, 1000)} + {i} * 7) % 12 + 1] END"
    return f"""guards_(i, name) AS ({_values([[x] for x in G.GUARDS])}), units_(i, name) AS ({_values([[x] for x in G.UNITS])}),
bank_(i, item, description, actions, timed) AS ({_values(G.BANK)}),
g AS (SELECT * FROM {lists('name', 'guards_', 3)}), u AS (SELECT * FROM {lists('name', 'units_', 2)}), b AS (SELECT * FROM {lists('i', 'bank_', 7)}),
placed AS (SELECT o_orderkey AS sheet, row_number() OVER (ORDER BY md5(o_orderkey || ':20'), o_orderkey) AS place, count(*) OVER () AS n FROM orders),
dealt AS (SELECT sheet, CASE WHEN place <= floor(0.7::DOUBLE * n) THEN 'train' WHEN place <= floor(0.7::DOUBLE * n) + floor(0.15::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM placed),
sheets AS MATERIALIZED (SELECT sheet, split, CASE WHEN {num(1)} < 52 THEN 'Dia' ELSE 'Noite' END AS shift, strftime(DATE '2026-01-01' + ({num(2, 365)})::INT, '%Y-%m-%d') AS day,
  concat_ws(', ', {guard(0)}, CASE WHEN {num(4)} >= 35 THEN {guard(1)} END, CASE WHEN {num(4)} >= 80 THEN {guard(2)} END) AS guards,
  CASE WHEN split = 'test' THEN u.every[{num(6, 10)} + 1] ELSE u.shared[{num(6, 8)} + 1] END AS unit, {num(7)} < {no_change} AS no_change, {num(7)} < {no_change} AND {num(8)} < 25 AS struck,
  CASE WHEN {num(7)} < {no_change} THEN 0 WHEN {num(9)} < 55 THEN 1 WHEN {num(9)} < 85 THEN 2 ELSE 3 END AS n_rows,
  CASE WHEN {num(10)} < 20 THEN 'clean' WHEN {num(10)} < 70 THEN 'scan' ELSE 'photo' END AS difficulty,
  CASE WHEN split = 'test' AND {num(11)} < 25 THEN 'C' WHEN {num(12, 2)} = 0 THEN 'A' ELSE 'B' END AS template FROM dealt, g, u)"""


def _corpus_rows(seed: int, no_change: int) -> str:
    num = lambda salt, below=100: G.number("(sheet * 10 + pos)", seed, salt, below)
    time = lambda m: f"lpad((({m}) % 1440 // 60)::VARCHAR, 2, '0') || ':' || lpad((({m}) % 60)::VARCHAR, 2, '0')"
    letter = lambda salt: f"chr((65 + {num(salt, 26)})::INT)"
    plate = f"{letter(51)} || {letter(52)} || {letter(53)} || {num(54, 10)} || {letter(55)} || lpad(({num(56, 100)})::VARCHAR, 2, '0')"
    one = lambda salt, names: f"{names!r}[{num(salt, len(names))} + 1]"
    filled = f"replace(replace(replace(replace(description, '{{setor}}', {one(30, G.SECTORS)}), '{{placa}}', {plate}), '{{empresa}}', {one(31, G.COMPANIES)}), '{{nome}}', {one(32, G.VISITORS)})"
    return f"""{_corpus(seed, no_change)},
drawn_ AS (SELECT sheet, split, p.pos, CASE WHEN split = 'test' THEN b.every[{num(20, 36)} + 1] ELSE b.shared[{num(20, 29)} + 1] END AS bank,
  (CASE shift WHEN 'Dia' THEN 6 ELSE 18 END + {num(21, 12)}) * 60 + {num(22, 60)} AS start FROM sheets JOIN range(3) p(pos) ON p.pos < n_rows, b),
truths AS MATERIALIZED (SELECT sheet, pos, split, item, CASE WHEN timed THEN {time('start')} END AS entry, CASE WHEN timed AND {num(23)} < 30 THEN {time(f'start + 10 + {num(24, 111)}')} END AS exit,
  {filled} AS descricao, actions[{G.number("(sheet * 10 + pos)", seed, 25, 0).replace('% 0)', '% len(actions))')} + 1] AS acao,
  CASE WHEN {num(26)} < 60 THEN 'sim' WHEN {num(26)} < 85 THEN 'nao' ELSE '' END AS resolvido FROM drawn_ JOIN bank_ ON bank_.i = bank)"""


def _keys(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("sheet"))


@query(f"WITH {_corpus(43, 50)} SELECT * FROM sheets")
def generated_sheets(spark, d):
    return G.corpus(_keys(spark, d), 43, "balanced")


@query(f"WITH {_corpus_rows(45, 50)} SELECT * FROM truths")
def generated_rows(spark, d):
    return G.corpus_rows(G.corpus(_keys(spark, d), 45, "balanced"), 45).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_corpus(44, 70)} SELECT split, template, count(*) AS n, count_if(no_change) AS n_no_change, count_if(struck) AS n_struck FROM sheets GROUP BY 1, 2")
def split_assignment(spark, d):
    return G.corpus(_keys(spark, d), 44, "operational").groupBy("split", "template").agg(F.count("*").alias("n"), F.count_if("no_change").alias("n_no_change"), F.count_if("struck").alias("n_struck"))


# the surface operators in DuckDB's lists
_LETTERS, _TWINS = "".join(G.ALIKE), "".join(G.ALIKE.values())


def _abbreviate(t: str) -> str:
    tests = " ".join(f"WHEN strpos({t}, '{a}') > 0 THEN substr({t}, 1, strpos({t}, '{a}') - 1) || '{b}' || substr({t}, strpos({t}, '{a}') + {len(a)})" for a, b in G.ABBREVIATIONS.items())
    return f"CASE {tests} ELSE {t} END"


def _list(t: str) -> str:
    return f"list_filter(string_split({t}, ' '), lambda w: w <> '')"


def _misspell(t: str, n: str) -> str:
    ws = _list(t)
    places = f"list_filter(range(1, len({ws}) + 1), lambda i: length({ws}[i]) >= 4)"
    place = f"{places}[({n}) % greatest(len({places}), 1) + 1]"
    word = f"{ws}[{place}]"
    p = f"(({n}) % greatest(length({word}) - 1, 1) + 1)"
    new = f"substr({word}, 1, ({p} - 1)::INT) || substr({word}, ({p} + 1)::INT, 1) || substr({word}, {p}::INT, 1) || substr({word}, ({p} + 2)::INT)"
    return f"CASE WHEN len({places}) = 0 THEN {t} ELSE array_to_string({ws}[1:({place} - 1)] || [{new}] || {ws}[({place} + 1):], ' ') END"


def _ambiguous(t: str, n: str) -> str:
    places = f"list_filter(range(1, length({t}) + 1), lambda i: contains('{_LETTERS}', substr({t}, i::INT, 1)))"
    at = f"{places}[({n}) % greatest(len({places}), 1) + 1]"
    return f"CASE WHEN len({places}) > 0 THEN substr({t}, 1, ({at} - 1)::INT) || translate(substr({t}, {at}::INT, 1), '{_LETTERS}', '{_TWINS}') || substr({t}, ({at} + 1)::INT) ELSE {t} END"


def _partial(t: str) -> str:
    ws = _list(t)
    return f"CASE WHEN len({ws}) < 2 THEN {t} ELSE array_to_string({ws}[1:greatest(1, len({ws}) // 2)], ' ') END"


def _crossout(t: str, n: str) -> str:
    ws = _list(t)
    at = f"(({n}) % greatest(len({ws}), 1) + 1)"
    return f"CASE WHEN len({ws}) = 0 THEN {t} ELSE array_to_string({ws}[1:({at} - 1)] || ['[risc:' || {ws}[{at}] || '] ' || {ws}[{at}]] || {ws}[({at} + 1):], ' ') END"


_NAMES = "concat(CASE p_partkey % 5 WHEN 0 THEN 'Portaria ' WHEN 1 THEN 'equipamento 101 ' WHEN 2 THEN 'Il 0O ' ELSE '' END, p_name)"


@query(
    f"""WITH t AS (SELECT p_partkey, {_NAMES} AS t FROM part)
SELECT p_partkey, {_abbreviate('t')} AS abbreviated, {_misspell('t', 'p_partkey')} AS misspelled, {_ambiguous('t', 'p_partkey')} AS swapped, {_partial('t')} AS half, {_crossout('t', 'p_partkey')} AS crossed, regexp_replace({_crossout('t', 'p_partkey')}, '\\[risc:([^\\]]*)\\]', '\\1', 'g') AS plain FROM t"""
)
def surface_operators(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{_NAMES} AS t")
    t, k = F.col("t"), F.col("p_partkey")
    return rows.select(
        "p_partkey", G.abbreviate(t).alias("abbreviated"), G.misspell(t, k).alias("misspelled"), G.ambiguous_swap(t, k).alias("swapped"), G.partial(t).alias("half"), G.crossout(t, k).alias("crossed"),
        G.plain(G.crossout(t, k)).alias("plain"),
    )


_SEED = 45


def _surface() -> str:
    key = "(sheet * 10 + pos)"
    num = lambda salt, below=100: G.number(key, _SEED, salt, below)
    which, out, last = num(77, 1009), f"{_corpus_rows(_SEED, 50)}, rows0 AS MATERIALIZED (SELECT *, descricao AS drawn, []::VARCHAR[] AS applied FROM truths)", "rows0"
    # the rates of each kind of noise in percent
    steps = (("abbreviate", 30, 71, _abbreviate("drawn")), ("misspell", 20, 72, _misspell("drawn", which)), ("crossout", 7, 73, _crossout("drawn", which)), ("partial", 10, 74, _partial("drawn")), ("ambiguous", 15, 75, _ambiguous("drawn", which)))
    for i, (name, rate, salt, op) in enumerate(steps, 1):
        out += f""",
made{i} AS MATERIALIZED (SELECT *, CASE WHEN {num(salt)} < {rate} THEN {op} ELSE drawn END AS new FROM {last}),
rows{i} AS MATERIALIZED (SELECT * EXCLUDE (new, drawn, applied), new AS drawn, CASE WHEN new <> drawn THEN applied || ['{name}:descricao'] ELSE applied END AS applied FROM made{i})"""
        last = f"rows{i}"
    return f"""{out},
timed AS MATERIALIZED (SELECT *, CASE WHEN entry IS NOT NULL THEN concat_ws(' - ', entry, exit) END AS hora FROM {last}),
swapped AS MATERIALIZED (SELECT *, CASE WHEN {num(78)} < 15 THEN {_ambiguous('hora', which)} ELSE hora END AS hora2 FROM timed),
surface AS MATERIALIZED (SELECT sheet, pos, split, item, hora2 AS hora, descricao AS truth, drawn AS descricao, CASE WHEN {num(79)} < 8 THEN NULL ELSE acao END AS acao,
  CASE resolvido WHEN 'sim' THEN 'sim' WHEN 'nao' THEN 'não' END AS resolvido,
  applied || CASE WHEN coalesce(hora2 <> hora, false) THEN ['ambiguous:hora'] ELSE [] END || CASE WHEN {num(79)} < 8 THEN ['blank:acao'] ELSE [] END AS applied, {num(80)} < 5 AS illegible FROM swapped),
headers AS MATERIALIZED (SELECT sheet, strftime(day::DATE, '%d/%m/%Y') || ' - ' || shift AS data_text, guards AS guards_text, unit, CASE WHEN {G.number('sheet', _SEED, 70, 100)} < 30 THEN {_abbreviate('unit')} ELSE unit END AS unit_text, no_change, n_rows FROM sheets)"""


def _made(spark, d):
    sheets = G.corpus(_keys(spark, d), _SEED, "balanced")
    return G.drawn_headers(sheets, _SEED), G.surface(G.corpus_rows(sheets, _SEED), _SEED)


@query(f"WITH {_surface()} SELECT sheet, pos, split, item, hora, truth, descricao, acao, resolvido, array_to_string(applied, ',') AS applied, illegible FROM surface")
def generated_surface(spark, d):
    return _made(spark, d)[1].withColumn("pos", F.col("pos").cast("long")).withColumn("applied", F.array_join("applied", ","))


@query(f"WITH {_surface()} SELECT CASE resolvido WHEN 'sim' THEN true WHEN 'não' THEN false END AS resolved, count(*) AS n FROM surface GROUP BY 1")
def resolved_answers(spark, d):
    """The drawn answers as the rules read them: yes, no, or none."""
    return _made(spark, d)[1].groupBy(extract.resolved(F.col("resolvido")).alias("resolved")).agg(F.count("*").alias("n"))


@query(f"WITH {_surface()} SELECT sheet, data_text, guards_text, unit_text, CASE WHEN unit_text <> unit THEN 'abbreviate:unidade' ELSE '' END AS applied FROM headers")
def generated_headers(spark, d):
    """Headers as they are drawn: only the unit may be abbreviated."""
    return _made(spark, d)[0].select("sheet", "data_text", "guards_text", "unit_text", F.array_join("applied", ",").alias("applied"))


@query(
    f"""WITH {_surface()}, kinds AS (SELECT unnest(applied) AS kind FROM surface UNION ALL SELECT 'illegible:descricao' FROM surface WHERE illegible UNION ALL SELECT 'abbreviate:unidade' FROM headers WHERE unit_text <> unit)
SELECT kind, count(*) AS n FROM kinds GROUP BY 1"""
)
def generated_noise(spark, d):
    """How often each kind of noise changed something."""
    headers, rows = _made(spark, d)
    scribbled = F.when(F.col("illegible"), F.array(F.lit("illegible:descricao"))).otherwise(F.array().cast("array<string>"))
    kinds = rows.select(F.explode(F.concat("applied", scribbled)).alias("kind")).unionByName(headers.select(F.explode("applied").alias("kind")))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


def _texts() -> str:
    row = f"concat_ws(' ', hora, CASE WHEN illegible THEN '{G.ILLEGIBLE}' ELSE regexp_replace(descricao, '\\[risc:([^\\]]*)\\]', '\\1', 'g') END, acao, nullif(resolvido, ''))"
    return f"""{_surface()}, bodies AS MATERIALIZED (SELECT sheet, string_agg({row}, chr(10) || chr(10) ORDER BY pos) AS body FROM surface GROUP BY 1),
texts AS (SELECT c.sheet, concat_ws(chr(10), 'Controle de ocorrencias', 'Data e Turno: ' || data_text, 'Vigilantes: ' || guards_text, 'Unidade: ' || unit_text, '{G.COLUMN_LINE}', CASE WHEN no_change THEN 'S/A' ELSE coalesce(body, '') END, 'Ronda: ok', '') AS text, no_change, n_rows
  FROM headers c LEFT JOIN bodies USING (sheet))"""


@query(f"WITH {_texts()} SELECT sheet, sha256(text) AS sha FROM texts")
def generated_texts(spark, d):
    return G.ideal_lines(*_made(spark, d)).select("sheet", F.sha2("text", 256).alias("sha"))


@query(f"WITH {_texts()} SELECT CASE WHEN no_change THEN 'none' ELSE 'present' END AS disposition, n_rows::BIGINT AS occurrences, count(*) AS n FROM texts GROUP BY ALL")
def generated_models(spark, d):
    """What the rules read of generated sheets: every row and every explicit no-change, as the truth has them."""
    found = extract.models(G.ideal_lines(*_made(spark, d)).withColumnRenamed("sheet", "sheet_id"))
    return found.groupBy("disposition", "occurrences").agg(F.count("*").alias("n"))


@query(f"WITH {B.ROWS} SELECT noise, count(*) AS n, sum(levenshtein(truth_desc, surface))::BIGINT AS edits, count_if(surface = truth_desc) AS unchanged FROM sheet_rows GROUP BY 1")
def surface_noise(spark, d):
    rows = sheet_rows(spark, d)
    return rows.groupBy("noise").agg(F.count("*").alias("n"), F.sum(F.levenshtein("truth_desc", "surface")).alias("edits"), F.count_if(F.col("surface") == F.col("truth_desc")).alias("unchanged"))


@query(
    f"""WITH n AS (SELECT c_name AS name, row_number() OVER (ORDER BY md5(c_name || '{G.HELD_OUT_SEED}'), c_name) AS place FROM customer), h AS (SELECT name, place <= (SELECT greatest(1, round(count(*) * 0.2)) FROM customer) AS test_only FROM n)
SELECT test_only, count(*) AS n, min(name) AS first, (SELECT count(*) FROM (SELECT name FROM h WHERE test_only INTERSECT SELECT name FROM h WHERE NOT test_only)) AS n_both FROM h GROUP BY 1"""
)
def heldout_vocabulary(spark, d):
    """Shared and test-only names, exactly a fifth, and whether any name is both."""
    names = G.held_out(table(spark, d, "customer").select(F.col("c_name").alias("name")))
    both = names.where("test_only").select("name").intersect(names.where("not test_only").select("name")).agg(F.count("*").alias("n_both"))
    return names.groupBy("test_only").agg(F.count("*").alias("n"), F.min("name").alias("first")).crossJoin(F.broadcast(both))  # one row


_SHARES = "SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) * CASE WHEN user_id % 10 = 0 THEN 1.1 ELSE 1 END - CASE WHEN user_id % 10 = 1 AND event_type = 'view' THEN 2 ELSE 0 END AS p FROM events GROUP BY 1, 2"


@query(f"WITH p AS ({_SHARES}) SELECT user_id AS prior, round(sum(p), 9) AS total, min(p) AS least, abs(round(sum(p), 9) - 1) <= 1e-6 AND min(p) >= 0 AS valid FROM p GROUP BY 1")
def prior_validity(spark, d):
    """Shares of each user's events as a distribution; every tenth user's don't sum to one, and some are negative."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    whole = n.groupBy("user_id").agg(F.sum("n").alias("whole"))
    k = F.col("user_id")
    p = F.col("n") / F.col("whole") * F.when(k % 10 == 0, 1.1).otherwise(1) - F.when((k % 10 == 1) & (F.col("event_type") == "view"), 2).otherwise(0)
    return G.valid_distribution(n.join(whole, "user_id").select(k.alias("prior"), p.alias("p")))


@query(
    """WITH b AS (SELECT event_id, 10.0 AS low, 10.0 + value AS high, (event_id % 100) / 100 AS share, CASE event_id % 3 WHEN 0 THEN 'lower80' WHEN 1 THEN 'upper20' ELSE 'all' END AS band FROM events),
c AS (SELECT *, low + 0.8 * (high - low) AS cut FROM b)
SELECT event_id, CASE band WHEN 'lower80' THEN low + share * (cut - low) WHEN 'upper20' THEN cut + share * (high - cut) ELSE low + share * (high - low) END::DOUBLE AS value FROM c"""
)
def banded_values(spark, d):
    k = F.col("event_id")
    low = F.lit(10.0)
    band = F.when(k % 3 == 0, "lower80").when(k % 3 == 1, "upper20").otherwise("all")
    return table(spark, d, "events").select("event_id", G.banded(low, low + F.col("value"), (k % 100) / 100, band).alias("value"))


_ENTRIES = """entries AS (SELECT 'tc-' || lpad((doc_id % 1000000)::VARCHAR, 6, '0') AS doc_id, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, 'pngs/tc-' || lpad((doc_id % 1000000)::VARCHAR, 6, '0') || '.png' AS image,
  'gt/tc-' || lpad((doc_id % 1000000)::VARCHAR, 6, '0') || '.json' AS gt, sha256(coalesce(lang, '')) AS sha256_img, sha256(coalesce(text, '')) AS sha256_gt FROM documents)"""


def entries(spark, d):
    name = manifest.doc_name(F.col("doc_id"))
    k = F.col("doc_id")
    sha = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    return table(spark, d, "documents").select(
        name.alias("doc_id"), F.when(k % 3 == 0, "train").when(k % 3 == 1, "val").otherwise("test").alias("split"), F.concat(F.lit("pngs/"), name, F.lit(".png")).alias("image"),
        F.concat(F.lit("gt/"), name, F.lit(".json")).alias("gt"), sha("lang").alias("sha256_img"), sha("text").alias("sha256_gt"),
    )


_LINE = """'{"doc_id":"' || doc_id || '","gt":"' || gt || '","image":"' || image || '","sha256_gt":"' || sha256_gt || '","sha256_img":"' || sha256_img || '","split":"' || split || '"}'"""


@query(
    f"""WITH RECURSIVE {_ENTRIES}, l AS (SELECT sha256({_LINE}) AS line, count(*) AS n FROM entries GROUP BY 1),
deep AS (SELECT min(d) AS d FROM range(12) r(d) WHERE 64 * 16 ** d >= (SELECT count(*) FROM entries)),
leaves AS (SELECT d, substr(line, 1, d::INT) AS node, sha256(string_agg(line || ':' || n, chr(10) ORDER BY line)) AS sha, sum(n)::BIGINT AS n FROM l, deep GROUP BY ALL),
tree AS (SELECT d, node, sha, n FROM leaves UNION ALL SELECT d - 1, substr(node, 1, (d - 1)::INT), sha256(string_agg(node || ':' || sha, chr(10) ORDER BY node)), sum(n)::BIGINT FROM tree WHERE d > 0 GROUP BY d, substr(node, 1, (d - 1)::INT))
SELECT n AS n_rows, sha FROM tree WHERE d = 0"""
)
def canonical_hash(spark, d):
    """One hash of a manifest's canonical lines, whatever the order of its rows."""
    return contracts.manifest_sha(entries(spark, d))


_LINES = f"""lines AS (SELECT row_number() OVER () AS r, doc_id AS own, CASE (substr(doc_id, 4)::INT) % 40 WHEN 1 THEN '  ' WHEN 2 THEN 'not json' WHEN 3 THEN replace({_LINE}, '"gt":', '"gt":"x","gt":') WHEN 4 THEN replace({_LINE}, '"split"', '"part"') WHEN 5 THEN replace({_LINE}, 'tc-', 'td-')
  WHEN 6 THEN upper({_LINE}) WHEN 7 THEN replace({_LINE}, '.png', '.jpg') WHEN 8 THEN replace({_LINE}, sha256_gt, 'abc') ELSE {_LINE} END AS text FROM entries)"""


@query(
    f"""WITH {_ENTRIES}, {_LINES}, p AS (SELECT *, (length(text) - length(replace(text, '"gt":', ''))) // 5 AS n_gt, CASE WHEN json_valid(text) THEN list_sort(json_keys(text)) END AS keys, CASE WHEN json_valid(text) THEN json_extract_string(text, '$.doc_id') END AS id,
   CASE WHEN json_valid(text) THEN json_extract_string(text, '$.image') END AS image, CASE WHEN json_valid(text) THEN json_extract_string(text, '$.gt') END AS gt, CASE WHEN json_valid(text) THEN json_extract_string(text, '$.sha256_gt') END AS h, CASE WHEN json_valid(text) THEN json_extract_string(text, '$.split') END AS split FROM lines),
e AS (SELECT *, CASE WHEN trim(text) = '' THEN 'blank line' WHEN n_gt > 1 THEN 'not strict JSON: duplicate key' WHEN NOT json_valid(text) THEN 'not strict JSON: not JSON' WHEN keys <> ['doc_id', 'gt', 'image', 'sha256_gt', 'sha256_img', 'split'] THEN 'other keys'
  WHEN NOT regexp_matches(id, '^tc-[0-9]{{6}}$') THEN 'bad id' WHEN NOT regexp_matches(h, '^[0-9a-f]{{64}}$') THEN 'bad hash' WHEN image <> 'pngs/' || id || '.png' OR gt <> 'gt/' || id || '.json' THEN 'bad path' WHEN split <> 'val' THEN 'wrong split' END AS error FROM p),
t AS (SELECT *, CASE WHEN error IS NULL THEN count(*) FILTER (error IS NULL) OVER (PARTITION BY id) END AS n FROM e)
SELECT coalesce(error, CASE WHEN n > 1 THEN 'repeated doc_id' END, 'ok') AS error, count(*) AS n FROM t GROUP BY 1"""
)
def manifest_lines(spark, d):
    """A manifest read strictly; every fault that a line can have is planted."""
    line = contracts.canonical_json(F.struct(*contracts.ENTRY_KEYS), contracts.ENTRY_KEYS)
    k = F.substring("doc_id", 4, 6).cast("int") % 40
    swap = lambda a, b: F.replace(line, a if not isinstance(a, str) else F.lit(a), F.lit(b))
    text = (
        F.when(k == 1, "  ").when(k == 2, "not json").when(k == 3, swap('"gt":', '"gt":"x","gt":')).when(k == 4, swap('"split"', '"part"')).when(k == 5, swap("tc-", "td-"))
        .when(k == 6, F.upper(line)).when(k == 7, swap(".png", ".jpg")).when(k == 8, swap(F.col("sha256_gt"), "abc")).otherwise(line)
    )
    lines = entries(spark, d).select(F.monotonically_increasing_id().alias("line_number"), text.alias("text"))
    return contracts.entry_errors(lines, "val").groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_ENTRIES}, numbered AS (SELECT *, substr(doc_id, 4)::INT AS k FROM entries),
files AS (SELECT image, CASE WHEN k % 17 = 3 THEN sha256('x') ELSE sha256_img END AS img_found, k % 19 <> 4 AS png_valid FROM numbered WHERE k % 13 <> 0),
truths AS (SELECT doc_id, CASE WHEN k % 23 = 5 THEN sha256('y') ELSE sha256_gt END AS gt_found, CASE WHEN k % 29 = 6 THEN 'tc-999999' ELSE doc_id END AS document_id, CASE WHEN k % 31 = 7 THEN 'draft' ELSE 'synthetic_ground_truth' END AS review_status, 'generator' AS truth_source,
  k % 5 = 0 AS no_change, CASE WHEN k % 5 = 0 AND k % 7 = 0 THEN 1 ELSE k % 3 END AS n_occurrences, CASE WHEN k % 37 = 8 THEN 'v2' ELSE 'v1' END AS version, split AS gt_split FROM numbered),
e AS (SELECT CASE WHEN img_found IS NULL OR gt_found IS NULL THEN 'files missing' WHEN NOT png_valid THEN 'not a PNG' WHEN img_found <> sha256_img THEN 'image hash differs' WHEN gt_found <> sha256_gt THEN 'truth hash differs' WHEN document_id <> n.doc_id THEN 'truth of another sheet'
  WHEN review_status <> 'synthetic_ground_truth' OR truth_source <> 'generator' THEN 'not generated truth' WHEN no_change AND n_occurrences > 0 THEN 'no change with occurrences' WHEN version <> 'v1' THEN 'provenance: version' WHEN gt_split <> split THEN 'provenance: gt_split' END AS error
  FROM numbered n LEFT JOIN files USING (image) LEFT JOIN truths t ON t.doc_id = n.doc_id)
SELECT coalesce(error, 'ok') AS error, count(*) AS n FROM e GROUP BY 1"""
)
def manifest_verified(spark, d):
    """A manifest against its files and truth sheets; every fault is planted."""
    rows = entries(spark, d)
    k = F.substring("doc_id", 4, 6).cast("int")
    files = rows.where(k % 13 != 0).select(F.col("image").alias("path"), F.when(k % 17 == 3, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256_img")).alias("sha256"), (k % 19 != 4).alias("png_valid"))
    truths = rows.select(
        "doc_id", F.when(k % 23 == 5, F.sha2(F.lit("y"), 256)).otherwise(F.col("sha256_gt")).alias("sha256"), F.when(k % 29 == 6, "tc-999999").otherwise(F.col("doc_id")).alias("document_id"),
        F.when(k % 31 == 7, "draft").otherwise("synthetic_ground_truth").alias("review_status"), F.lit("generator").alias("truth_source"), (k % 5 == 0).alias("no_change"),
        F.when((k % 5 == 0) & (k % 7 == 0), 1).otherwise(k % 3).alias("n_occurrences"), F.when(k % 37 == 8, "v2").otherwise("v1").alias("version"), F.col("split").alias("gt_split"),
    )
    out = contracts.verified(rows, files, truths, {"version": "v1", "gt_split": "<split>"})
    return out.groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN '{"a": 1, "a": 2, "x": ' || props || '}' WHEN event_id % 77 = 0 THEN '{"v": NaN}' WHEN event_id % 91 = 0 THEN '[1]' WHEN event_id % 97 = 0 THEN '{"b": "' || repeat('z', 1100000) || '"}' WHEN event_id % 101 = 0 THEN '{' ELSE props END AS t FROM events)
SELECT event_id, CASE WHEN strlen(t) > 1048576 THEN 'too large' WHEN contains(t, '"a": 1, "a"') THEN 'duplicate key' WHEN contains(t, 'NaN') THEN 'not a number' WHEN NOT json_valid(t) THEN 'not JSON' WHEN NOT starts_with(t, '{') THEN 'not an object' ELSE 'ok' END AS verdict FROM t"""
)
def strict_json_events(spark, d):
    k, p = F.col("event_id"), F.col("props")
    # the length follows from the row, so that the plan holds no text of a megabyte
    long = F.repeat(F.lit("z"), F.when(k % 97 == 0, 1_100_000).otherwise(0))
    text = (
        F.when(k % 50 == 0, F.concat(F.lit('{"a": 1, "a": 2, "x": '), p, F.lit("}"))).when(k % 77 == 0, '{"v": NaN}').when(k % 91 == 0, "[1]")
        .when(k % 97 == 0, F.concat(F.lit('{"b": "'), long, F.lit('"}'))).when(k % 101 == 0, "{").otherwise(p)
    )
    return table(spark, d, "events").select("event_id", contracts.bounded_json(text.cast("binary")).alias("verdict"))


@query(
    """WITH t AS (SELECT event_id, '{"z":' || event_id || ',"source_file":"x","b":"é","a":[' || event_id % 3 || ',{"y":1,"k":' || (props::JSON->>'k') || '}]}' AS raw, '{"a":[' || event_id % 3 || ',{"k":' || (props::JSON->>'k') || ',"y":1}],"b":"é","z":' || event_id || '}' AS sorted FROM events)
SELECT event_id, sha256(sorted) AS sha, strlen(raw) > strlen(sorted) AS shorter FROM t"""
)
def canonical_sheets(spark, d):
    """Sheets as JSON in no order, and their canonical form's hash."""
    number = F.get_json_object("props", "$.k")
    k = F.col("event_id").cast("string")
    raw = F.concat(F.lit('{"z":'), k, F.lit(',"source_file":"x","b":"é","a":['), (F.col("event_id") % 3).cast("string"), F.lit(',{"y":1,"k":'), number, F.lit("}]}"))
    rows = table(spark, d, "events").select("event_id", raw.alias("raw")).withColumn("canonical", contracts.canonical_sheet(F.col("raw")))
    return rows.select("event_id", F.sha2("canonical", 256).alias("sha"), (F.octet_length("raw") > F.octet_length("canonical")).alias("shorter"))


@query(
    """SELECT event_id, list_sort(json_keys(CASE WHEN event_id % 9 = 0 THEN '{"k": 1, "extra": 2}' WHEN event_id % 11 = 0 THEN '{}' ELSE props END)) = ['k'] AS exact FROM events"""
)
def exact_keys(spark, d):
    k = F.col("event_id")
    text = F.when(k % 9 == 0, '{"k": 1, "extra": 2}').when(k % 11 == 0, "{}").otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", contracts.exact_keys(F.map_keys(F.from_json(text, "map<string,string>")), ["k"]).alias("exact"))


@query("SELECT 'sheet_' || row_number() OVER (ORDER BY c_custkey) AS sheet, c_mktsegment, c_nationkey FROM customer")
def public_rows(spark, d):
    """What a whitelist lets out, under numbers instead of names."""
    return contracts.public(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], "c_custkey")


_DB = "CASE s_suppkey % 5 WHEN 0 THEN 'private/app.db' WHEN 1 THEN concat('private/old', s_suppkey, '.db') WHEN 2 THEN concat('src/data/x', s_suppkey, '.sqlite') WHEN 3 THEN concat('tmp/', s_suppkey, '.db') ELSE concat('docs/', s_suppkey, '.db') END"
_CLASSED = f"""dbs AS (SELECT s_suppkey, s_nationkey, {_DB} AS path, s_suppkey % 3 = 0 AS tracked FROM supplier),
classed AS (SELECT *, CASE WHEN path = 'private/app.db' THEN 'expected_private_db' WHEN starts_with(path, 'private/') THEN 'private_db' WHEN tracked THEN 'tracked_outside_private' WHEN contains(path, '/data/') THEN 'data_db' ELSE 'db_outside_private' END AS kind FROM dbs)"""


def databases(spark, d):
    rows = table(spark, d, "supplier").selectExpr("s_nationkey", f"{_DB} AS path", "s_suppkey % 3 = 0 AS tracked")
    return rows.withColumn("kind", contracts.database_class(F.col("path"), F.col("tracked")))


@query(f"WITH {_CLASSED} SELECT kind, count(*) AS n FROM classed GROUP BY 1")
def database_counts(spark, d):
    return databases(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_CLASSED}, l AS (SELECT s_nationkey, CASE WHEN kind = 'tracked_outside_private' THEN 2 WHEN kind IN ('data_db', 'db_outside_private') THEN 1 ELSE 0 END AS level, kind FROM classed)
SELECT s_nationkey, max(level) AS severity, coalesce(array_to_string(list_sort(list(DISTINCT kind) FILTER (level > 0)), ','), '') AS actions FROM l GROUP BY 1"""
)
def severity_max(spark, d):
    """The worst of each group, and what to do about it."""
    levels = databases(spark, d).select("s_nationkey", contracts.database_level(F.col("kind")).alias("level"), F.col("kind").alias("action"))
    return contracts.severity(levels, "s_nationkey").withColumn("actions", F.array_join("actions", ","))


_PATHS = "CASE p_partkey % 8 WHEN 0 THEN concat('docs/', p_partkey, '.png') WHEN 1 THEN concat('samples/', p_partkey, '.PNG') WHEN 2 THEN concat('private/', p_partkey, '.pdf') WHEN 3 THEN concat('src/', p_partkey, '.py') WHEN 4 THEN concat('data/synthetic/', p_partkey, '.db') WHEN 5 THEN concat('x/', p_partkey, '.sqlite3') WHEN 6 THEN concat('notes/', p_partkey, '.Tiff') ELSE concat('a/', p_partkey, '.md') END"


@query(
    f"""WITH f AS (SELECT {_PATHS} AS path, p_partkey % 3 = 0 AS tracked FROM part), s AS (SELECT *, regexp_extract(lower(path), '\\.([a-z0-9]+)$', 1) AS x, starts_with(path, 'private/') OR starts_with(path, 'data/synthetic/') AS private FROM f),
v AS (SELECT path, CASE WHEN x IN ('db', 'sqlite', 'sqlite3') AND tracked THEN 'tracked database' WHEN x IN ('png', 'pdf', 'tiff') AND tracked AND NOT starts_with(path, 'samples/') THEN 'tracked sensitive file'
  WHEN NOT private AND x IN ('db', 'sqlite', 'sqlite3') THEN 'database outside private' WHEN NOT private AND x IN ('png', 'pdf', 'tiff') AND NOT starts_with(path, 'samples/') THEN 'sensitive file outside private' END AS violation FROM s)
SELECT path, violation FROM v WHERE violation IS NOT NULL"""
)
def path_violations(spark, d):
    paths = table(spark, d, "part").selectExpr(f"{_PATHS} AS path", "p_partkey % 3 = 0 AS tracked")
    return contracts.path_violations(paths).select("path", "violation")


_OUT = "CASE o_orderkey % 5 WHEN 0 THEN concat('/work/private/run', o_orderkey) WHEN 1 THEN concat('/work/private/../docs/', o_orderkey) WHEN 2 THEN concat('/work/docs/', o_orderkey) WHEN 3 THEN concat('/work/private/docs/', o_orderkey) ELSE '/work/privateer/x' END"


@query(f"WITH p AS (SELECT o_orderkey, {_OUT} AS path FROM orders) SELECT o_orderkey, starts_with(path, '/work/private/') AND NOT regexp_matches(path, '(^|/)\\.\\.(/|$)') AND NOT regexp_matches(path, '(^|/)docs(/|$)') AS allowed FROM p")
def output_paths(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey", f"{_OUT} AS path")
    return rows.select("o_orderkey", contracts.output_allowed(F.col("path"), "/work/private").alias("allowed"))


@query("SELECT 'd' || o_orderkey AS document_id, o_orderpriority AS review_status, o_orderstatus AS unidade FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def review_status_filter(spark, d):
    """Truth sheets as JSON, of the statuses asked for."""
    text = F.to_json(F.struct(F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("document_id"), F.col("o_orderpriority").alias("review_status"), F.struct(F.col("o_orderstatus").alias("unidade")).alias("cabecalho")))
    files = table(spark, d, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".json")).alias("file"), text.alias("text"))
    return json_sheets.parsed(files, ["1-URGENT", "2-HIGH"]).select("document_id", "review_status", F.col("cabecalho.unidade").alias("unidade"))


@query(
    """WITH RECURSIVE w AS (SELECT p_partkey, string_split(concat(p_name, ' ', p_brand, ' ', p_type, ' ', p_name, ' ', repeat('x', (p_partkey % 30)::INT)), ' ') AS ws FROM part),
f AS (SELECT p_partkey, ws, 1 AS i, []::VARCHAR[] AS out FROM w UNION ALL SELECT p_partkey, ws, i + 1, CASE WHEN len(out) > 0 AND length(out[-1]) + 1 + length(ws[i]) <= 20 THEN out[1:len(out) - 1] || [out[-1] || ' ' || ws[i]] ELSE out || [ws[i]] END FROM f WHERE i <= len(ws))
SELECT p_partkey, len(out)::INT AS n_lines, array_to_string(out, chr(10)) AS wrapped FROM f WHERE i = len(ws) + 1"""
)
def wrapped_lines(spark, d):
    """Greedy wrapping of the text that a form's field would hold."""
    text = F.expr("concat(p_name, ' ', p_brand, ' ', p_type, ' ', p_name, ' ', repeat('x', cast(p_partkey % 30 AS int)))")
    lines = forms.wrapped(F.split(text, " "), 20)
    return table(spark, d, "part").select("p_partkey", F.size(lines).alias("n_lines"), F.array_join(lines, "\n").alias("wrapped"))
