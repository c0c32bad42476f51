"""Small tables with the cases every operator must take."""

import random


def lines(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(words))


def documents() -> list[tuple]:
    """(doc_id, text): near copies, copies, shared passages, nulls, empty, long, blank, repeated and clashing rows."""
    base, passage = lines(1, 120), lines(2, 60)
    words = base.split()
    near = " ".join([*words[:50], "changed", *words[51:]])
    far = " ".join([*words[:60], *lines(3, 60).split()])
    return [
        (1, base), (2, near), (3, base), (4, far), (5, None), (6, ""), (7, " \t\n "), (8, "one two"), (9, "one two"),
        (10, "ONE two"), (11, f"{lines(4, 30)} {passage} {lines(5, 20)}"), (12, f"{passage}\n{lines(6, 40)}"), (13, lines(7, 4000)),
        (14, f"{passage} x {passage}"), (15, base), (15, base), (16, "Ünïcode – ταμ 日本語 \U0001f600 the of and"), (None, base), (None, None), (17, "a"),
        (-3, f"{lines(8, 10)} the quick of brown and fox of the lazy dog and its friend"), (18, "x" * 5000),
    ]


def frame(spark, rows=None):
    """The documents with columns whose names operators use inside."""
    rows = documents() if rows is None else rows
    schema = "doc_id long, text string, id long, node long, tag string, component_id string, high int, kept string"
    return spark.createDataFrame([(i, t, 7, 8, "t", "c", 1, "k") for i, t in rows], schema)


def words(text, lower=False):
    data = (text or "").encode()
    return [w.decode() for w in (data.lower() if lower else data).split()]
