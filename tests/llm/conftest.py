import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

from conftest_llm import SF  # noqa: E402



@pytest.fixture(scope="session")
def documents():
    import pyarrow.parquet as pq
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.fixture(scope="session")
def make(spark):
    """DataFrame from rows, over several partitions."""
    def build(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)
    return build
