import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows_of(frame):
    """Rows of a pandas frame by sorted column, in order, with plain values."""

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        if hasattr(v, "__len__") and not isinstance(v, str | bytes):
            return tuple(map(plain, v))
        v = v.item() if hasattr(v, "item") else v
        return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="session")
def same_rows():
    return lambda a, b: (sorted(a.columns) == sorted(b.columns)) and rows_of(a) == rows_of(b)
