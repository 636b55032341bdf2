"""Deterministic corpus generation: sheets, occurrences, held-out vocabulary, splits, surface noise. A corpus grows from a table of
keys, one sheet a key. Choices follow from keys by remainders, so every engine makes the same corpus and no seed order matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import contracts

# Sizes, seeds and profiles of the canonical corpora; priors in percent.
CORPORA = {"smoke": (50, 42, "balanced"), "bench-balanced": (300, 43, "balanced"), "bench-operational": (300, 44, "operational"), "stress": (1000, 45, "balanced")}
PRIORS = {
    "shift": {"Dia": 52, "Noite": 48}, "difficulty": {"clean": 20, "scan": 50, "photo": 30}, "rows": {"1": 55, "2": 30, "3": 15}, "guards": {"1": 35, "2": 45, "3": 20}, "resolved": {"sim": 60, "nao": 25, "": 15},
}
NO_CHANGE = {"balanced": 50, "operational": 70}
STRUCK, EXIT, TEMPLATE_C = 25, 30, 25
NOISE = {"abbreviate": 30, "misspell": 20, "ambiguous": 15, "partial": 10, "blank": 8, "crossout": 7, "illegible": 5}
FIRST_DAY, DAYS = "2026-01-01", 365
HELD_OUT_SEED, HELD_OUT_PERCENT, SPLIT_SEED = 7, 20, 20
# Abbreviations of the form's words, the first that occurs counts; letters and digits that look alike; marks of a struck word.
ABBREVIATIONS = {
    "Portaria": "Port.", "Guarita": "Guar.", "Recepcao": "Recep.", "equipamento": "equip.", "monitoramento": "monit.", "nao autorizado": "n/ aut.", "ocorrencia": "ocorr.", "incendio": "incend.",
}
ALIKE = {"0": "O", "O": "0", "1": "l", "l": "1", "I": "1"}
CROSSED = ("[risc:", "]")
ILLEGIBLE, COLUMN_LINE = "[ilegivel]", "Item Hora Descricao da Ocorrencia Acao Resolvido"

# The vocabulary is this engine's own, made by rule.
GUARDS = [f"{chr(65 + i)}. Vigia {i + 1:02d}" for i in range(15)]
UNITS = [f"{place} {i:02d}" for i, place in enumerate(["Portaria", "Guarita", "Posto", "Recepcao", "Patio"] * 2, 1)]
SECTORS = ["Portaria", "Guarita", "Recepcao", "Patio", "Doca"]
COMPANIES = ["Norte Cargas", "Luz Manutencao", "Vale Entregas"]
VISITORS = ["Z. Prado", "Y. Serra", "X. Campos", "W. Matos"]
#: Thirty-six templates: item, description, its own actions, whether it has a time.
BANK = [
    ("camera", "lente da camera de {setor} coberta de poeira", ["lente limpa pela equipe", "limpeza pedida"], True),
    ("camera", "camera de {setor} virada para o muro", ["posicao corrigida"], True),
    ("monitoramento", "tela do monitoramento apagou e voltou", ["equipamento reiniciado", "falha anotada"], True),
    ("monitoramento", "monitoramento perdeu o sinal de {setor}", ["cabo trocado"], True),
    ("acesso", "{nome} pediu acesso a {setor} sem ordem escrita", ["pedido recusado"], True),
    ("acesso", "acesso da {empresa} liberado por telefone", ["ramal anotado", "ordem arquivada"], True),
    ("cracha", "cracha de {nome} fora da validade", ["cracha provisorio entregue"], True),
    ("cracha", "cracha caido perto de {setor}", ["guardado na gaveta do posto"], False),
    ("furto", "furto de cabos percebido em {setor}", ["policia chamada", "area isolada"], True),
    ("furto", "cadeado forcado em {setor}, furto nao consumado", ["cadeado trocado"], True),
    ("subtracao", "subtracao de ferramentas relatada pela {empresa}", ["relato assinado", "imagens separadas"], True),
    ("subtracao", "subtracao de uma bicicleta em {setor}", ["dono orientado a registrar"], True),
    ("incendio", "principio de incendio em lixeira de {setor}", ["extintor usado", "brigada chamada"], True),
    ("incendio", "porta corta-fogo de {setor} presa por caixas, risco de incendio", ["caixas retiradas"], False),
    ("alarme", "alarme de {setor} tocou duas vezes seguidas", ["sensor ajustado"], True),
    ("alarme", "painel de alarme com bateria fraca", ["bateria encomendada", "painel vigiado"], False),
    ("vazamento", "vazamento de agua junto a {setor}", ["registro fechado", "piso sinalizado"], True),
    ("vazamento", "goteira no teto de {setor} depois da chuva", ["balde posto no local"], True),
    ("equipamento", "equipamento da {empresa} deixado ligado", ["equipamento desligado"], True),
    ("equipamento", "radio portatil sem carga, equipamento reserva usado", ["radio posto a carregar"], False),
    ("portao", "portao de {setor} nao fecha ate o fim", ["corrente passada", "serralheiro chamado"], True),
    ("portao", "portao de {setor} aberto a mao por queda de luz", ["fechado ao voltar a luz"], True),
    ("carga", "carga da {empresa} com lacre rompido", ["carga recusada", "lacre fotografado"], True),
    ("carga", "carga esperou vaga em {setor} por uma hora", ["vaga liberada"], True),
    ("visitante", "visitante {nome} esperou autorizacao em {setor}", ["entrada autorizada por ramal"], True),
    ("visitante", "visitante {nome} nao autorizado voltou a {setor}", ["retirado com calma", "nome posto na lista"], True),
    ("veiculo", "veiculo {placa} da {empresa} parado na rampa", ["motorista chamado"], True),
    ("veiculo", "veiculo {placa} nao autorizado em {setor}", ["veiculo retirado", "placa anotada"], True),
    ("iluminacao", "poste de iluminacao apagado perto de {setor}", ["chamado aberto"], False),
    ("iluminacao", "iluminacao de {setor} acesa durante o dia", ["chave desligada"], True),
    ("ruido", "ruido de motor vindo de {setor}", ["origem nao achada", "volta feita no local"], True),
    ("ruido", "ruido de festa vizinha ate tarde", ["vizinho avisado"], True),
    ("obra", "obra da {empresa} em {setor} passou da hora", ["obra suspensa"], True),
    ("obra", "entulho de obra deixado em {setor}", ["retirada pedida"], False),
    ("entrega", "entrega da {empresa} sem nota", ["entrega devolvida", "nota pedida"], True),
    ("entrega", "entrega para {nome} guardada em {setor}", ["destinatario avisado"], True),
]


def number(key: str, seed: int, salt: int, below: int) -> str:
    """SQL: a number from 0 to below - 1 for a key, in integer arithmetic only. It is quadratic in the key, as numbers that are linear in it
    would follow from one another whatever the salt."""
    x = f"((({key}) * 7919 + {seed * 104_729 + salt * 1_299_709}) % 1000003)"
    return f"(({x} * {x} % 999983 * 7919 + {x}) % 1000003 % {below})"


def choice(value: str, prior: dict[str, int]) -> str:
    """SQL: the label in whose percents the value lies."""
    below, out = 0, []
    for label, percent in prior.items():
        below += percent
        out.append(f"WHEN {value} < {below} THEN '{label}'")
    return f"CASE {' '.join(out)} END"


def pick(value: str, names: list[str]) -> str:
    """SQL: the name at a place."""
    return "CASE " + value + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def two(value: str) -> str:
    """SQL: two digits."""
    return f"lpad(concat('', {value}), 2, '0')"


def clock(minutes: str) -> str:
    """SQL: minutes of a day as HH:MM; they wrap at midnight."""
    return f"concat({two(f'CAST(floor(({minutes}) % 1440 / 60) AS INT)')}, ':', {two(f'CAST(({minutes}) % 60 AS INT)')})"


def plate(key: str, seed: int) -> str:
    """SQL: three letters, a digit, a letter, two digits."""
    letter = lambda salt: f"substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST({number(key, seed, salt, 26)} AS INT) + 1, 1)"
    return f"concat({letter(51)}, {letter(52)}, {letter(53)}, {number(key, seed, 54, 10)}, {letter(55)}, {two(number(key, seed, 56, 100))})"


def filled(template: str, values: dict[str, str]) -> str:
    """SQL: a template expression with {names} replaced."""
    for name, value in values.items():
        template = f"replace({template}, '{{{name}}}', {value})"
    return template


def vocabulary(names: list[str], seed: int = HELD_OUT_SEED, percent: int = HELD_OUT_PERCENT) -> tuple[list[str], list[str]]:
    """Shared names, and the share that is for tests alone, rounded, one at least, by place in a seeded order."""
    order = sorted(range(len(names)), key=lambda i: ((i * 7919 + seed * 104_729) % 1_000_003 * 31 % 9973, i))
    held = set(order[: max(1, round(len(names) * percent / 100))])
    return [n for i, n in enumerate(names) if i not in held], [n for i, n in enumerate(names) if i in held]


def split_of(place: str, n: int) -> str:
    return f"CASE WHEN {place} <= {int(0.7 * n)} THEN 'train' WHEN {place} <= {int(0.7 * n) + int(0.15 * n)} THEN 'val' ELSE 'test' END"


def sheet_columns(seed: int, profile: str, key: str = "sheet") -> list[str]:
    """SQL of a sheet's columns from its number and split."""
    num = lambda salt, below=100: number(key, seed, salt, below)
    shared_guards, held_guards = vocabulary(GUARDS)
    shared_units, held_units = vocabulary(UNITS)
    step = lambda i, m: f"({num(5, 1000)} + {i} * 7) % {m}"  # seven and the sizes have no common factor, so names differ
    guard = lambda i: f"CASE WHEN split = 'test' THEN {pick(step(i, len(GUARDS)), [*shared_guards, *held_guards])} ELSE {pick(step(i, len(shared_guards)), shared_guards)} END"
    guards = choice(num(4), PRIORS["guards"])
    return [
        f"{choice(num(1), PRIORS['shift'])} AS shift",
        f"date_format(date_add(DATE '{FIRST_DAY}', CAST({num(2, DAYS)} AS INT)), 'yyyy-MM-dd') AS day",
        f"concat_ws(', ', {guard(0)}, CASE WHEN {guards} <> '1' THEN {guard(1)} END, CASE WHEN {guards} = '3' THEN {guard(2)} END) AS guards",
        f"CASE WHEN split = 'test' THEN {pick(num(6, len(UNITS)), [*shared_units, *held_units])} ELSE {pick(num(6, len(shared_units)), shared_units)} END AS unit",
        f"{num(7)} < {NO_CHANGE[profile]} AS no_change", f"{num(7)} < {NO_CHANGE[profile]} AND {num(8)} < {STRUCK} AS struck",
        f"CASE WHEN {num(7)} < {NO_CHANGE[profile]} THEN 0 ELSE CAST({choice(num(9), PRIORS['rows'])} AS INT) END AS n_rows",
        f"{choice(num(10), PRIORS['difficulty'])} AS difficulty",
        f"CASE WHEN split = 'test' AND {num(11)} < {TEMPLATE_C} THEN 'C' WHEN {num(12, 2)} = 0 THEN 'A' ELSE 'B' END AS template",
    ]


def drawn_columns(seed: int) -> list[str]:
    """SQL of what an occurrence's columns are made of: bank (the template's number), start (minutes)."""
    num = lambda salt, below=100: number("(sheet * 10 + pos)", seed, salt, below)
    shared, held = vocabulary([str(i) for i in range(len(BANK))])
    which = f"CASE WHEN split = 'test' THEN {pick(num(20, len(BANK)), [*shared, *held])} ELSE {pick(num(20, len(shared)), shared)} END"
    return [f"CAST({which} AS INT) AS bank", f"(CASE shift WHEN 'Dia' THEN 6 ELSE 18 END + {num(21, 12)}) * 60 + {num(22, 60)} AS start"]


def row_columns(seed: int) -> list[str]:
    """SQL of an occurrence's columns, from its sheet's, pos (from 0) and drawn_columns()."""
    key = "(sheet * 10 + pos)"
    num = lambda salt, below=100: number(key, seed, salt, below)
    timed = f"bank IN ({', '.join(str(i) for i, b in enumerate(BANK) if b[3])})"
    values = {"setor": pick(num(30, len(SECTORS)), SECTORS), "placa": plate(key, seed), "empresa": pick(num(31, len(COMPANIES)), COMPANIES), "nome": pick(num(32, len(VISITORS)), VISITORS)}
    actions = "CASE bank " + " ".join(f"WHEN {i} THEN {pick(num(25, len(b[2])), b[2])}" for i, b in enumerate(BANK)) + " END"
    return [
        f"{pick('bank', [b[0] for b in BANK])} AS item", f"CASE WHEN {timed} THEN {clock('start')} END AS entry",
        f"CASE WHEN {timed} AND {num(23)} < {EXIT} THEN {clock(f'(start + 10 + {num(24, 111)})')} END AS exit",
        f"{filled(pick('bank', [b[1] for b in BANK]), values)} AS descricao",
        f"{actions} AS acao", f"{choice(num(26), PRIORS['resolved'])} AS resolvido",
    ]


def corpus(keys: DataFrame, seed: int, profile: str) -> DataFrame:
    """From different whole numbers (sheet): sheet, split, shift, day, guards, unit, no_change, struck, n_rows, difficulty, template. 70, 15 and
    15 percent by the place in a seeded order; a fifth of names and templates, and one form, are seen in tests only. Ranges of the order
    are numbered by tasks of their own, so a corpus may have any size."""
    order = F.md5(F.concat(F.col("sheet").cast("string"), F.lit(f":{SPLIT_SEED}")).cast("binary"))
    keyed = keys.select(F.col("sheet").cast("long").alias("sheet"), F.struct(order.alias("k"), F.col("sheet")).alias("order"))
    n = keyed.count()
    first = F.conv(F.substring("order.k", 1, 8), 16, 10).cast("long")
    placed = contracts.numbered(keyed, "order", F.shiftright(first * (n // contracts.ROWS_A_BUCKET + 1), 32))
    return placed.selectExpr("sheet", f"{split_of('place', n)} AS split").selectExpr("*", *sheet_columns(seed, profile))


def canonical(spark: SparkSession, name: str) -> DataFrame:
    """One of the canonical corpora, whose sheets are numbered from 0."""
    n, seed, profile = CORPORA[name]
    return corpus(spark.range(n).select(F.col("id").alias("sheet")), seed, profile)


def corpus_rows(sheets: DataFrame, seed: int) -> DataFrame:
    """sheet, pos, split, item, entry, exit, descricao, acao, resolvido: the occurrences of corpus()."""
    rows = sheets.where("n_rows > 0").selectExpr("sheet", "split", "shift", "explode(sequence(0, n_rows - 1)) AS pos")
    return rows.selectExpr("*", *drawn_columns(seed)).selectExpr("sheet", "pos", "split", *row_columns(seed))


def abbreviate(text: Column) -> Column:
    """The first of the known words that the text has is abbreviated, where it comes first."""
    out = None
    for full, short in ABBREVIATIONS.items():
        at = F.instr(text, full)
        new = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(short), F.substring(text, at + len(full), F.length(text)))
        out = (F if out is None else out).when(at > 0, new)
    return out.otherwise(text)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _at(items: Column, place: Column, new: Column) -> Column:
    return F.transform(items, lambda x, i: F.when(i == place, new).otherwise(x))


def misspell(text: Column, which: Column) -> Column:
    """Two neighbours of one word of four letters or more change places; which chooses the word, and the place in it."""

    def one(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(F.length(w) >= 4, i)), lambda i: i.isNotNull())
        place = F.get(places, F.pmod(which, F.greatest(F.size(places), F.lit(1))).cast("int"))
        word = F.get(words, place)
        p = (F.pmod(which, F.greatest(F.length(word) - 1, F.lit(1))) + 1).cast("int")
        one_ = F.lit(1)
        new = F.concat(F.substring(word, one_, p - 1), F.substring(word, p + 1, one_), F.substring(word, p, one_), F.substring(word, p + 2, F.length(word)))
        return F.when(F.size(places) == 0, text).otherwise(F.array_join(_at(words, place, new), " "))

    return F.get(F.transform(F.array(_words(text)), one), F.lit(0))


def ambiguous_swap(text: Column, which: Column) -> Column:
    """One letter or digit becomes the one that looks like it."""
    letters = "".join(ALIKE)
    places = F.filter(F.transform(F.split(text, ""), lambda c, i: F.when((c != "") & F.contains(F.lit(letters), c), i + 1)), lambda i: i.isNotNull())
    at = F.get(places, F.pmod(which, F.greatest(F.size(places), F.lit(1))).cast("int"))
    letter = F.translate(F.substring(text, at, F.lit(1)), letters, "".join(ALIKE.values()))
    new = F.concat(F.substring(text, F.lit(1), at - 1), letter, F.substring(text, at + 1, F.length(text)))
    return F.when(F.size(places) > 0, new).otherwise(text)


def partial(text: Column) -> Column:
    """The first half of the words, one at least; a single word stays."""
    words = _words(text)
    n = F.size(words)
    return F.when(n < 2, text).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(1), F.floor(n / 2).cast("int"))), " "))


def crossout(text: Column, which: Column) -> Column:
    """One word struck out and written again."""
    words = _words(text)
    place = F.pmod(which, F.greatest(F.size(words), F.lit(1))).cast("int")
    word = F.get(words, place)
    return F.when(F.size(words) == 0, text).otherwise(F.array_join(_at(words, place, F.concat(F.lit(CROSSED[0]), word, F.lit(CROSSED[1] + " "), word)), " "))


def plain(text: Column) -> Column:
    """Without the marks of struck words."""
    return F.regexp_replace(text, r"\[risc:([^\]]*)\]", "$1")


def drawn_headers(sheets: DataFrame, seed: int) -> DataFrame:
    """corpus() with the header as drawn: data_text and guards_text are the truth's, unit_text may be abbreviated, and applied says so."""
    unit = F.when(F.expr(number("sheet", seed, 70, 100)) < NOISE["abbreviate"], abbreviate(F.col("unit"))).otherwise(F.col("unit"))
    day = F.concat(F.date_format(F.to_date("day"), "dd/MM/yyyy"), F.lit(" - "), "shift")
    drawn = sheets.select("*", day.alias("data_text"), F.col("guards").alias("guards_text"), unit.alias("unit_text"))
    changed = F.when(F.col("unit_text") != F.col("unit"), F.array(F.lit("abbreviate:unidade"))).otherwise(F.array().cast("array<string>"))
    return drawn.withColumn("applied", changed)


def surface(rows: DataFrame, seed: int) -> DataFrame:
    """corpus_rows() as drawn: hora in one cell, descricao and acao with noise, resolvido as it is written; applied names each change that was
    made, in order, and illegible marks a description that was scribbled. The truth stays beside it."""
    key = "(sheet * 10 + pos)"
    num = lambda salt, below=100: F.expr(number(key, seed, salt, below))
    which = F.expr(number(key, seed, 77, 1009))
    steps = [
        ("abbreviate", 71, lambda c: abbreviate(c)), ("misspell", 72, lambda c: misspell(c, which)), ("crossout", 73, lambda c: crossout(c, which)), ("partial", 74, lambda c: partial(c)),
        ("ambiguous", 75, lambda c: ambiguous_swap(c, which)),
    ]
    # each step binds the text once, so that no expression is written out again and again
    state = F.array(F.struct(F.col("descricao").alias("text"), F.array().cast("array<string>").alias("applied")))
    for name, salt, op in steps:
        state = _noised(state, num(salt) < NOISE[name], f"{name}:descricao", op)
    hora = F.array(F.struct(F.when(F.col("entry").isNotNull(), F.concat_ws(" - ", "entry", "exit")).alias("text"), F.array().cast("array<string>").alias("applied")))
    hora = _noised(hora, num(78) < NOISE["ambiguous"], "ambiguous:hora", lambda c: ambiguous_swap(c, which))
    out = rows.select("sheet", "pos", "split", "item", "descricao", "acao", "resolvido", F.get(state, F.lit(0)).alias("d"), F.get(hora, F.lit(0)).alias("h"), ((num(79) < NOISE["blank"]) & F.col("acao").isNotNull()).alias("gone"), (num(80) < NOISE["illegible"]).alias("illegible"))
    blank = F.when(F.col("gone"), F.array(F.lit("blank:acao"))).otherwise(F.array().cast("array<string>"))
    return out.select(
        "sheet", "pos", "split", "item", F.col("h.text").alias("hora"), F.col("descricao").alias("truth"), F.col("d.text").alias("descricao"), F.when(~F.col("gone"), F.col("acao")).alias("acao"),
        F.when(F.col("resolvido") == "sim", "sim").when(F.col("resolvido") == "nao", "não").alias("resolvido"),
        F.concat("d.applied", "h.applied", blank).alias("applied"), "illegible",
    )


def _noised(state: Column, when: Column, name: str, op) -> Column:
    """An array of one struct(text, applied) after a step of noise."""

    def step(s: Column) -> Column:
        made = F.transform(F.array(F.when(when, op(s["text"])).otherwise(s["text"])), lambda new: F.struct(new.alias("text"), F.when(new != s["text"], F.concat(s["applied"], F.array(F.lit(name)))).otherwise(s["applied"]).alias("applied")))
        return F.get(made, F.lit(0))

    return F.transform(state, step)


def ideal_lines(sheets: DataFrame, drawn: DataFrame) -> DataFrame:
    """sheet, text: the lines that a perfect reader would return of drawn_headers() with its surface(): heading, header, column line, rows parted by
    empty lines or the mark of no change, footer. Struck words are written plainly; an illegible description reads as its mark."""
    cell = F.when(F.col("illegible"), ILLEGIBLE).otherwise(plain(F.col("descricao")))
    row = F.concat_ws(" ", "hora", cell, F.nullif("acao", F.lit("")), F.nullif("resolvido", F.lit("")))
    body = drawn.select("sheet", "pos", row.alias("row")).groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("pos", "row"))).alias("rows"))
    body = body.select("sheet", F.array_join(F.transform("rows", lambda r: r["row"]), "\n\n").alias("body"))
    head = (("Data e Turno: ", "data_text"), ("Vigilantes: ", "guards_text"), ("Unidade: ", "unit_text"))
    lines = [F.lit("Controle de ocorrencias"), *(F.concat(F.lit(label), c) for label, c in head), F.lit(COLUMN_LINE)]
    shown = F.when(F.col("no_change"), "S/A").otherwise(F.coalesce("body", F.lit("")))
    return sheets.join(body, "sheet", "left").select("sheet", F.concat_ws("\n", *lines, shown, F.lit("Ronda: ok"), F.lit("")).alias("text"))


def banded(low: Column, high: Column, share: Column, band: Column) -> Column:
    """A value of a range from a share of 0 to 1: of its lower four fifths, its upper fifth, or all of it."""
    cut = low + 0.8 * (high - low)
    return F.when(band == "lower80", low + share * (cut - low)).when(band == "upper20", cut + share * (high - cut)).otherwise(low + share * (high - low))


def held_out(names: DataFrame, seed: int = HELD_OUT_SEED, percent: int = HELD_OUT_PERCENT) -> DataFrame:
    """name, test_only: the given share of a table of names, rounded, one at least, is for tests alone, by place in a seeded order, that of the names'
    hashes; tasks number ranges of hashes."""
    keyed = names.select("name", F.md5(F.concat(F.col("name"), F.lit(str(seed))).cast("binary")).alias("k")).withColumn("order", F.struct("k", "name"))
    n = keyed.count()
    buckets = n // contracts.ROWS_A_BUCKET + 1
    first = F.conv(F.substring("k", 1, 8), 16, 10).cast("long")
    return contracts.numbered(keyed, "order", F.shiftright(first * buckets, 32)).select("name", (F.col("place") <= max(1, round(n * percent / 100))).alias("test_only"))


def valid_distribution(priors: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """From (prior, p): prior, total, least, valid; probabilities aren't negative and sum to one."""
    sums = priors.groupBy("prior").agg(F.round(F.sum("p"), 9).alias("total"), F.min("p").alias("least"))
    return sums.withColumn("valid", (F.abs(F.col("total") - 1) <= tolerance) & (F.col("least") >= 0))
