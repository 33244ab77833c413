import os
import sys

import pytest

from tables import DOCS

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def frame(spark):
    """frame(schema, rows): a DataFrame of several partitions."""
    def make(schema, rows):
        return spark.createDataFrame(rows, schema).repartition(3)
    return make


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
