import datetime as dt
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SCHEMA = "symbol string, timestamp date, open double, high double, low double, close double, volume double"


def make_bars(symbol="AAA", n=120, seed=1, start=dt.date(2024, 1, 1)):
    """Rows of a random walk on calendar days."""
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.02, n)))
    high, low = close * (1 + rng.uniform(0.001, 0.02, n)), close * (1 - rng.uniform(0.001, 0.02, n))
    open_ = low + rng.uniform(0.2, 0.8, n) * (high - low)
    return [(symbol, start + dt.timedelta(days=i), *map(float, (open_[i], high[i], low[i], close[i], rng.integers(1000, 9000)))) for i in range(n)]


@pytest.fixture(scope="session")
def bars(spark):
    """Two symbols; rows in no order."""
    rows = make_bars("AAA", seed=1) + make_bars("BBB", seed=2)
    order = np.random.default_rng(0).permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], SCHEMA).cache()
    df.count()
    return df


@pytest.fixture(scope="session")
def closes(spark):
    """A table of one symbol from a list of closes."""

    def make(values, **columns):
        names = ["symbol", "timestamp", "close", *columns]
        rows = [("S", dt.date(2024, 1, 1) + dt.timedelta(days=i), v, *(c[i] for c in columns.values())) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "symbol string, timestamp date, close double" + "".join(f", {c} double" for c in columns)) if rows else spark.createDataFrame([], ", ".join(f"{n} double" for n in names))

    return make


@pytest.fixture(scope="session")
def column():
    """Values of a column in the order of symbol and time."""

    def get(df, name, symbol=None):
        rows = df.orderBy("symbol", "timestamp").select("symbol", name).collect()
        return [r[1] for r in rows if symbol is None or r[0] == symbol]

    return get
