"""Strict and canonical JSON in the JVM against Python's parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyrook.functions import strict_json
from tallyrook.operators import contracts

CASES = [
    '{"a":1}', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1,"a":2}', '{"x":{"a":1,"a":1}}', '[{"a":1,"a":1}]', "NaN", '{"v":NaN}', '{"v":-Infinity}', '{"v": Infinity}', "[1,]", '{"a":1,}', "{'a':1}",
    '{"a":01}', '{"a":1.}', '{"a":.5}', '{"a":1e5}', '"x', "null", "", "  ", ' {"a" : 2.50 } ', '{"a":-0}', '{"a":"\t"}', '{"a":"\\t \\u00e9 \\" \\\\ "}', "tru", "+1", '{"a":1/2}', '/*c*/{"a":1}', '﻿{"a":1}', '{"":1}',
    '{"a":[1,[2,{"b":null}]]}', '{"\\u0061":1,"a":2}', '{"a":"\\x"}', '{"a":"NaN"}', '{"a":"NaN","b":NaN}', '{"a":"\\"NaN"}', '{"a":"' + "\\n" * 20_000 + '","a":1}', '{"a":"' + "z" * 200_000 + '"', "]", "1] [2", "[" * 500 + "]" * 500,
]


def python(text):
    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise KeyError
        return dict(pairs)

    def constant(_):
        raise ZeroDivisionError

    try:
        return "ok", json.loads(text, object_pairs_hook=once, parse_constant=constant)
    except ValueError:
        return "not JSON", None
    except KeyError:
        return "duplicate key", None
    except ZeroDivisionError:
        return "not a number", None


def test_verdicts_are_pythons(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "i int, t string").select("i", strict_json.verdict(F.col("t")).alias("v"))
    assert {r.i: r.v for r in df.collect()} == {i: python(t)[0] for i, t in enumerate(CASES)}
    assert spark.createDataFrame([(None,)], "t string").select(strict_json.verdict(F.col("t")).alias("v")).first().v == "not JSON"


def made(rnd, depth=0):
    kind = rnd.randrange(7 if depth < 4 else 5)
    if kind == 5:
        return [made(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    if kind == 6:
        return {rnd.choice(["b", "a", "Z", "é", "source_file", "", "0"]) + str(rnd.randrange(5)): made(rnd, depth + 1) for _ in range(rnd.randrange(5))}
    return [None, True, rnd.randrange(-(10**15), 10**15), rnd.randrange(100) / 4, rnd.choice(["", "x", "é ü", 'q"u\\o', "l\ni\tn", "漢字 🙂"])][kind]


def test_canonical_form_is_pythons(spark):
    """Keys sorted at every depth, also of random nested sheets; numbers are compared by value."""
    rnd = random.Random(11)
    sheets = [{"source_file": "x", **{f"k{i}": made(rnd) for i in range(rnd.randrange(6))}} for _ in range(200)]
    texts = [json.dumps(dict(rnd.sample(list(s.items()), len(s))), ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1])) for s in sheets]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", contracts.canonical_sheet(F.col("t")).alias("c"))
    for r in df.collect():
        want = {k: v for k, v in sheets[r.i].items() if k != "source_file"}
        ordered = json.loads(r.c, object_pairs_hook=lambda pairs: (_ for _ in ()).throw(AssertionError(pairs)) if [k for k, _ in pairs] != sorted(k for k, _ in pairs) else dict(pairs))
        assert ordered == want and ": " not in r.c.replace(": ", "", sum(": " in str(v) for v in want.values()))


@pytest.mark.parametrize("text", ["[1]", "1", "null", '{"a":1,"a":2}', "", None])
def test_what_has_no_canonical_form(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(contracts.canonical_sheet(F.col("t")).alias("c")).first().c is None


def test_no_python_worker(spark, sf):
    from tallyrook.plans import data_queries

    for name in ("strict_json_events", "canonical_sheets", "manifest_lines"):
        plan = data_queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
