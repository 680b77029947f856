import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Columns whose names clash with those that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, rid long, score double, part int, shard int, n int, leaks int, pii string, id long, learned boolean"


def rows(texts, first=0):
    return [(first + i if i != 3 else None, t, "en", "s", len(t or ""), 1, "k", 1, 0.5, 1, 1, 1, 1, "p", 1, True) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls, empty and very long texts, repeated rows and equal texts, stored once."""
    long = "The quick brown fox number %d jumps over idiot dogs. "
    texts = ["same words here and there again", "same words here and there again", None, "no id at all", "", "  \n\t ", "x", "é" * 300, "a@b.c " * 50, "".join(long % i for i in range(4000)), "y" * 120_000]
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    data = rows(texts)
    spark.createDataFrame([*data, data[0], data[4]], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
