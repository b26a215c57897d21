import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
from samples import EDGES  # noqa: E402


@pytest.fixture(scope="session")
def edges(spark):
    """Documents with every odd case, and columns named like those inside the operators."""
    df = spark.createDataFrame(EDGES, "doc_id long, text string").repartition(3)
    return df.withColumns(
        {c: F.lit(c) for c in ("id", "key", "rest", "lang", "forms", "hashes", "class", "file", "w", "h")}
    )


@pytest.fixture(scope="session")
def nothing(spark, edges):
    return spark.createDataFrame([], edges.schema)


def table(df):
    return [tuple(r) for r in df.collect()]
