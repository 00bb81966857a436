"""Small tables with everything that is odd: nulls, empty and long texts, ties, copies, clashing column names."""

import random

WORDS = "the of and on idiot house green walks under three river stone cloud paper lamp again never seven".split()
CLASH = {
    "n": "bigint", "size": "int", "label": "int", "score": "double", "shard": "string", "law": "int", "component_id": "string",
    "_number": "string", "_spans": "int", "_row": "int", "number": "int", "node": "int", "key": "string", "at": "int", "hash": "string", "piece": "int", "held_out": "int",
}


def prose(draw, n):
    return " ".join(draw.choice(WORDS) + draw.choice(["", "s", "ed", "ing"]) for _ in range(n))


def odd_documents(seed=1):
    """(doc_id, text): near and exact copies, shared passages, empty, null, short, very long, repeated rows."""
    draw = random.Random(seed)
    rows = []
    base = [prose(draw, 60) for _ in range(6)]
    shared = prose(draw, 40)
    for i in range(60):
        words = base[i % 6].split()
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(len(words))] = draw.choice(WORDS)
        rows.append(" ".join(words) + ("\n" + shared if i % 3 == 0 else ""))
    rows += ["", None, " \t\n ", "one", "one two three four", "One TWO three four", base[0], base[0], "x" * 350, "ab" * 200]
    rows += ["naïve Straße " * 30, "ñandú " + shared, "é" + shared, prose(draw, 30_000), "a\x00b\x1cc " + shared]
    return list(enumerate(rows, 10))


def table(spark, rows, extra=True):
    """The rows as documents, with columns whose names clash with the operators' own."""
    schema = "doc_id bigint, text string" + "".join(f", {n} {t}" for n, t in CLASH.items() if extra)
    return spark.createDataFrame([(*r, *([None] * len(CLASH) if extra else [])) for r in rows], schema)
