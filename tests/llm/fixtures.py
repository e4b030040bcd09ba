"""Small document tables with the cases every operator must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "node long, text_only string, id long, key string, band long, items string, n long"


def prose(seed: int, n: int, syllables: str = "an be co du el fi go hu in jo") -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(syllables.split()) for _ in range(draw.randint(1, 3))) for _ in range(n))


LANGUAGES = {"aa": "an be co du el fi go hu in jo", "bb": "zu vy xo wi qua sze tsch rij ky"}


def documents(spark, rows=None, extra: bool = False):
    """Two languages; a null and an empty text, a null id, a repeated row, one long text, a text without letters."""
    if rows is None:
        rows = [(k, prose(k, 60, LANGUAGES["aa" if k % 2 else "bb"]), "aa" if k % 2 else "bb", "s", 0) for k in range(1, 41)]
        rows += [(41, None, "aa", None, None), (42, "", None, "s", 0), (None, prose(43, 30), None, None, None), (1, *rows[0][1:])]
        rows += [(44, prose(44, 30_000, LANGUAGES["bb"]), "bb", "s", 1), (45, "12345 -- 67", None, "s", 11), (46, "short text", "aa", "s", 10)]
    made = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for column in CLASHING.split(", "):
            name, kind = column.split()
            made = made.withColumn(name, F.lit("7").cast(kind))
    return made
