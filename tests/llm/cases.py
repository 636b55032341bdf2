"""Documents with nulls, empty and very long texts, ties and repeated rows, and columns whose names clash with internal ones."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, _id string, tid string, words long"


def documents(seed=7, n=40):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "porta", "ação", "zéz", "a", "x1", "end,", "B", "ccc"] + [f"w{i}" for i in range(300)]
    make = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    texts = [make(rnd.randrange(1, 250)) + rnd.choice(["", "\n", "\n\n" + make(4)]) for _ in range(n)]
    near = make(200).split()
    for _ in range(4):
        copy = list(near)
        copy[rnd.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    passage = make(120)
    texts += [make(60) + " " + passage + " " + make(60), make(30) + " " + passage + make(80), " ".join(near), " ".join(near)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), "r", 1, "q", "t", 2) for i, t in enumerate(texts)]
    odd = [(900, None), (901, ""), (902, " \n\t "), (903, "a"), (904, "ab " * 9000), (904, "ab " * 9000), (905, "x" * 30_000), (None, make(90)), (None, None)]
    rows += [(i, t, None, None, None, None, None, None, None, None) for i, t in odd]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
