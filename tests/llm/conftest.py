import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or add to their results.
CLASHING = "shard slot size row node k1 label bucket target kept __t __k1 __own __kept_text __bad n_lines template good path".split()

LONG = "one two three four five six seven eight nine ten " * 30_000
PROSE = "The river runs past the old mill and the children count the boats that come down from the hills each day."


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    rows = [
        (None, PROSE + " Null id.", "en", "a", 3),
        (1, None, "en", "a", 0),
        (2, "", "en", "b", 0),
        (3, " \n\t ", None, "b", None),
        (4, LONG, "en", None, 7),
        (5, PROSE, "en", "a", 9),
        (5, PROSE, "en", "a", 9),
        (6, PROSE, "en", "c", 9),
        (7, "één ünïcode 漢字 😀 <0x41> ▁", "fr", "é", 1),
        (8, "word", "en", "a", 1),
        (9, PROSE.upper() + "\n" + PROSE.upper(), "en", "d", 1),
        (-3, "two words", "de", "", 1),
        (None, None, None, None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows(), DOCS)
    return docs.select("*", *[F.lit(1).alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, folder):
    """Rows of the smallest table of documents."""
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()]
