"""Occurrence sheets derived from the order tables: truth, noisy drawn rows, and the text that a reader would return.

Everything follows from keys by remainders, so any engine makes the same sheets. One sheet an order, one row a line item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet_id, l_linenumber, truth_desc, truth_hora, truth_item, truth_action, truth_resolved, noise, surface, line: the occurrences
    of each sheet that has any."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    busy = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = items.join(busy, "l_orderkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.selectExpr(
        "l_orderkey AS sheet_id", "l_linenumber", "l_partkey", "l_suppkey", "cast(l_quantity AS int) AS quantity",
        "concat(CASE l_partkey % 6 WHEN 0 THEN 'camera ' WHEN 1 THEN 'acesso ' WHEN 2 THEN 'furto ' WHEN 3 THEN 'alarme ' ELSE '' END, p_name, ' setor ', cast(l_suppkey AS string)) AS truth_desc",
        "concat(lpad(cast(l_partkey % 24 AS string), 2, '0'), ':', lpad(cast(l_suppkey % 60 AS string), 2, '0')) AS entry",
        "CASE WHEN l_partkey % 5 = 0 THEN concat(lpad(cast((l_partkey + 1) % 24 AS string), 2, '0'), ':', lpad(cast(l_suppkey % 60 AS string), 2, '0')) END AS exit",
        "l_returnflag AS truth_item", "CASE WHEN l_suppkey % 3 = 0 THEN 'equipe avisada' ELSE '' END AS truth_action", "CASE l_linestatus WHEN 'F' THEN 'sim' ELSE '' END AS truth_resolved",
        "CASE (l_partkey + l_suppkey) % 7 WHEN 1 THEN 'swap' WHEN 2 THEN 'partial' WHEN 3 THEN 'illegible' WHEN 4 THEN 'crossout' ELSE 'none' END AS noise",
    ).selectExpr(
        "*",
        "CASE noise WHEN 'swap' THEN translate(truth_desc, 'aeo', 'eoa') WHEN 'partial' THEN substring(truth_desc, 1, cast(floor(length(truth_desc) / 2) AS int)) "
        "WHEN 'illegible' THEN '[ilegivel]' WHEN 'crossout' THEN concat('[risc:', substring(truth_desc, 1, 4), '] ', truth_desc) ELSE truth_desc END AS surface",
    ).selectExpr(
        "*", "concat_ws(' ', entry, exit) AS truth_hora", "l_partkey % 9 = 0 AS merged",
        "concat_ws(' ', entry, CASE WHEN exit IS NOT NULL THEN 'saida' END, exit, regexp_replace(surface, '\\\\[risc:([^\\\\]]*)\\\\]', '$1')) AS line",
    )


#: What orders a sheet's occurrences; line numbers repeat.
ORDER = ("l_linenumber", "line", "truth_desc", "noise", "quantity", "truth_hora", "merged")
TRUTH = ("truth_desc", "truth_hora", "truth_item", "truth_action", "truth_resolved", "noise", "surface")


def sheets(spark: SparkSession, sf_dir: str, truth: bool = False) -> DataFrame:
    """sheet_id, text, truth_date, truth_guards, truth_unit, truth_n, difficulty, template, split; with truth also the true
    occurrences in the order drawn, as an array, and drawn, the text that was drawn. The truth lies in the sheet's own row, so that
    scoring needs no join."""
    fields = dict.fromkeys((*ORDER, *(TRUTH if truth else ())))
    body = sheet_rows(spark, sf_dir).groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    body = body.select(
        "sheet_id", F.size("rows").alias("n"),
        F.array_join(F.transform("rows", lambda r: F.concat(r["line"], F.when(r["merged"], "\n").otherwise("\n\n"))), "").alias("body"),
        *([F.col("rows").alias("truth")] if truth else []),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    base = orders.join(people, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    extra = ["truth"] if truth else []
    base = base.join(body, F.col("o_orderkey") == F.col("sheet_id"), "left").selectExpr(
        "o_orderkey AS k", "o_orderstatus", "coalesce(n, 0) AS n", "coalesce(body, '') AS body", "n_name",
        "date_format(o_orderdate, 'dd/MM/yyyy') AS day", "c_name AS guard", "concat('Guarda ', cast(o_orderkey % 17 AS string)) AS other",
        *extra,
    ).selectExpr(
        "*",
        "CASE k % 4 WHEN 0 THEN guard WHEN 1 THEN concat(guard, ', ', other) WHEN 2 THEN concat(guard, ' e ', other) ELSE concat(guard, ' / ', other, '; Chefe') END AS drawn_guards",
        "CASE k % 4 WHEN 0 THEN guard WHEN 3 THEN concat(guard, ', ', other, ', Chefe') ELSE concat(guard, ', ', other) END AS truth_guards",
    )
    if truth:
        shown = F.transform("truth", lambda r: F.concat_ws(" ", r["truth_hora"], r["surface"]))
        day = "CASE WHEN k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN day ELSE concat(day, CASE WHEN k % 2 = 0 THEN ' - Dia' ELSE ' - Noite' END) END"
        drawn = F.concat_ws(" ", F.expr(day), F.col("drawn_guards"), F.expr("CASE WHEN k % 19 <> 0 THEN n_name END"), F.array_join(shown, " "))
        base = base.withColumn("drawn", F.replace(F.replace(drawn, F.lit("[risc:")), F.lit("]")))
        extra = ["coalesce(truth, array()) AS truth", "drawn"]
    return base.selectExpr(
        "k AS sheet_id", *extra,
        "concat('Controle de ocorrencias\n', "
        "CASE WHEN k % 13 = 0 THEN 'Data e Turno:' WHEN k % 11 = 0 THEN concat('Data: ', day) ELSE concat('Data e Turno: ', day, CASE WHEN k % 2 = 0 THEN ' - Dia' ELSE ' - Noite' END) END, '\n', "
        "'Vigilantes: ', drawn_guards, '\n', CASE WHEN k % 19 = 0 THEN 'Unidade:' ELSE concat('Unidade: ', n_name) END, '\n', "
        "CASE WHEN k % 7 = 0 THEN '' ELSE 'Item Hora Descricao da Ocorrencia Acao Resolvido\n' END, "
        "CASE WHEN o_orderstatus = 'F' THEN CASE k % 3 WHEN 0 THEN 'S/A\n' WHEN 1 THEN '5/A\n\nS1A\n' ELSE ' s|a \n' END ELSE body END, "
        "CASE WHEN k % 10 < 8 THEN 'Ronda: ok\nMonitoramento\n' ELSE '' END, CASE WHEN k % 23 = 0 THEN '\fcontinua sem tabela\n' ELSE '' END) AS text",
        "concat(day, CASE WHEN k % 11 = 0 THEN '' WHEN k % 2 = 0 THEN ' - Dia' ELSE ' - Noite' END) AS truth_date", "truth_guards", "n_name AS truth_unit", "n AS truth_n",
        "CASE k % 5 WHEN 0 THEN 'clean' WHEN 1 THEN 'photo' WHEN 2 THEN 'photo' ELSE 'scan' END AS difficulty",
        "CASE WHEN k % 20 >= 17 AND k % 4 = 0 THEN 'C' WHEN k % 2 = 0 THEN 'A' ELSE 'B' END AS template",
        "CASE WHEN k % 20 < 14 THEN 'train' WHEN k % 20 < 17 THEN 'val' ELSE 'test' END AS split",
    )
