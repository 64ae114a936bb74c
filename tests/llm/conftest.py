import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """rows of (doc_id, text[, lang, source]) -> documents, over several partitions."""
    def make(rows, parts=3):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)
    return make


@pytest.fixture(scope="session")
def clashing():
    """Add columns whose names the operators use themselves."""
    def add(df):
        from pyspark.sql import functions as F
        names = ["row", "size", "bits", "seq", "slot", "rank", "words", "target", "copies", "kept", "tid", "n", "h", "own",
                 "len", "head", "key", "_n", "count", "p", "depth", "band", "src", "id", "text_md5", "wins", "component"]
        return df.withColumns({n: F.lit("x") for n in names})
    return add


@pytest.fixture(scope="session")
def awkward(make_docs):
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    return make_docs([
        (1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l"),
        (None, "a b c d e f g h i j k l"), (None, None), (3, None), (4, ""), (5, " \n\t"), (6, "one"), (7, "ONE"),
        (8, "wörd " * 60_000, None, None), (9, "wörd " * 60_000, "de", None), (10, "x" * 200_000, "en", ""),
        (11, "12 34 !!", "en", "s")])
