"""Small tables with everything that documents may hold."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DDL = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use inside.
CLASHES = ("score", "size", "h", "row", "key", "fp", "k", "stratum", "kind", "pattern", "toxic", "target", "block", "file")


def frame(spark: SparkSession, rows: list[tuple], clashes: bool = True) -> DataFrame:
    """``rows``: (doc_id, text[, lang[, source]])."""
    full = [tuple((list(r) + [None] * 4)[:4]) + (None,) for r in rows]
    df = spark.createDataFrame(full, DDL)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clashes else df


def prose(n: int, seed: int = 0) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(["the", "quick", "brown", "fox", "jumps", "over", "lazy", "dogs", "and", "runs", "home",
                                "again", "while", "rain", "falls", "on", "green", "hills", "near", "old", "towns"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, prose(30, 4), "en", "a"), (5, prose(30, 4), "en", "a"),
            (5, prose(30, 4), "en", "a"), (6, prose(40_000, 6), None, None), (None, prose(20, 7), "en", "b"),
            (7, "x" * 100_000, "fr", "b"), (8, "é ü \U0001F600 " * 20, "de", None), (9, "1 " * 20_000, "es", "a")]
