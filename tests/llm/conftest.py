from __future__ import annotations

import pytest

ID_TEXT = "doc_id long, text string"


@pytest.fixture(scope="session")
def table(spark):
    def make(rows, schema=ID_TEXT, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make
