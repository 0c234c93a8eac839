"""Small document tables with the cases that every operator must survive."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, key string, kept boolean, size double"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    parts = ["the", "of", "an", "re", "stone", "river", "ing", "mo", "ter", "lake", "ble", "run"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(words))


def edge_rows() -> list[tuple]:
    """(doc_id, text): NULLs, empties, white space, copies, a repeated row, a very long text, other alphabets."""
    base = prose(1, 300)
    near = base.split()
    near[150] = "changed"
    rows = [(0, base), (1, None), (2, ""), (3, " \t\n"), (4, base), (5, base.replace(" ", "\n  ")), (6, " ".join(near)),
            (7, prose(2, 400)), (8, "日本語 テキスト 😀 ü"), (9, LONG), (10, prose(3, 3)), (11, base + " " + prose(4, 200)),
            (12, "a"), (13, prose(5, 60)), (13, prose(5, 60)), (14, "x\x00y <|endoftext|> z"), (15, prose(6, 90) + "  " + prose(7, 90))]
    return rows


def frame(spark, rows=None, **columns):
    rows = edge_rows() if rows is None else rows
    full = [(i, t, ("en", "de", None)[k % 3], ("s1", "s2", None)[k % 3], k, 5, 6, "k", True, 1.5) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
