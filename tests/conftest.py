import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])

DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """A function that runs SQL over the tables of a directory."""
    import duckdb

    def run(sql: str, sf_dir: str):
        c = duckdb.connect()
        c.execute("SET TimeZone = 'UTC'")
        for p in Path(sf_dir).glob("*.parquet"):
            c.execute(f"CREATE VIEW {p.stem} AS FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
        return c.execute(sql).df()

    return run


@pytest.fixture(scope="session")
def equal():
    """Holds a Spark result against a pandas one, whatever the order of rows."""

    def norm(df):
        import pandas as pd

        def cell(x):
            if isinstance(x, float):
                return "nan" if x != x else f"{x:.9g}"
            if hasattr(x, "tolist") and not isinstance(x, pd.Timestamp):
                x = x.tolist()
            return "nan" if x is None or x is pd.NaT else str(x)

        return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))

    def check(a, b):
        a = a.toPandas() if hasattr(a, "toPandas") else a
        assert sorted(a.columns) == sorted(b.columns)
        left, right = norm(a), norm(b)
        assert len(left) == len(right)
        assert left == right

    return check
