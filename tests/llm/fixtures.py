"""Small tables with every awkward case, and columns whose names clash with those operators use inside."""

import random

from pyspark.sql import functions as F

CLASHES = ("score", "fp", "words", "_words", "_uid", "_k1", "_k2", "anchor", "batch", "spans", "uid", "length", "component_id", "hit_words", "rep", "base", "n")


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéßñ") for _ in range(rnd.randint(2, 7))) for _ in range(vocabulary)]
    out = [rnd.choice(words) for _ in range(n)]
    for at in range(7, n, 9):
        out[at] = rnd.choice(["the", "of", "and", "de", "la", "der"])
    return " ".join(out)


PASSAGE = prose(99, 60)
LONG = prose(5, 6000, 3000)
ROWS = [
    (1, prose(1, 150)), (2, prose(2, 150) + " " + PASSAGE), (3, PASSAGE + "\n" + prose(3, 120)), (4, prose(1, 150)), (5, prose(1, 149)),
    (6, None), (7, ""), (8, " \t\n"), (9, "one"), (10, LONG), (11, "Spam " * 120), (12, "same line here\nsame line here\nother"),
    (13, "### $$$ *** " * 20), (14, prose(1, 150)), (14, prose(1, 150)), (15, prose(8, 40) + "\n" + prose(8, 40)), (None, prose(2, 150) + " " + PASSAGE), (16, "É" * 300),
    (17, f"x password={'a1b2c3d4' * 2} y AKIA{'ABCD1234' * 2} z {'0123456789abcdef' * 2} w"), (18, "api_key: short PASSWORD = 'long+enough/value' token=abc"), (19, prose(1, 150).upper()),
    (14, prose(77, 30)),
]
ITEMS = [(1, PASSAGE), (2, "One"), (3, None), (4, "..."), (10, " ".join(PASSAGE.split()[10:25]).upper()), (None, prose(8, 12)), (1, PASSAGE)]


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(c) for c in CLASHES})


def benchmark(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string").withColumns({c: F.lit(1) for c in ("_hash", "_len", "doc_id", "source")})


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*(names or df.columns)).collect()), key=repr)
