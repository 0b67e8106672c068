import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from siftline.session import local_session

    session = local_session("siftline-tests", **{
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rules():
    from siftline import starter_rules

    return starter_rules()


@pytest.fixture(scope="session")
def as_of():
    return "2026-09-24"


@pytest.fixture
def ask(spark):
    """ask([(a, b), ...], 'a string, b string', {name: Column}) -> list of dicts in input order."""
    from pyspark.sql import functions as F

    def run(rows, schema, **columns):
        data = [(i, *(row if isinstance(row, tuple) else (row,))) for i, row in enumerate(rows)]
        df = spark.createDataFrame(data, f"_i int, {schema}")
        out = df.select("_i", *[column.alias(name) for name, column in columns.items()]).orderBy("_i").collect()
        assert len(out) == len(data)
        return [{k: v for k, v in r.asDict(recursive=True).items() if k != "_i"} for r in out]

    run.col = F.col
    return run
