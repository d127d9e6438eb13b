import os
import sys
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

UTC = timezone.utc
DAY0 = datetime(2026, 1, 1, tzinfo=UTC)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def bar(ts, close, open_=None, high=None, low=None, volume=1000.0, symbol="AAA", exchange="XNSE", timeframe="1d"):
    open_ = close if open_ is None else open_
    return (symbol, exchange, timeframe, ts, float(open_), float(max(open_, close) if high is None else high), float(min(open_, close) if low is None else low), float(close), float(volume))


@pytest.fixture(scope="session")
def candles(spark):
    """candles(closes, volumes=..., ...) -> a DataFrame of daily bars of one series."""
    from barloom.functions.candles import SCHEMA

    def make(closes, highs=None, lows=None, volumes=None, **key):
        n = len(closes)
        rows = [bar(DAY0 + timedelta(days=i), closes[i], high=highs and highs[i], low=lows and lows[i], volume=(volumes or [1000.0] * n)[i], **key) for i in range(n)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


def trend_bars(spark, n, base=100.0, volume=1000.0, spike=None, symbol="AAA"):
    from barloom.functions.candles import SCHEMA

    rows = []
    for i in range(n):
        p = (base + 0.5 * i) * (100.0 if spike == i else 1.0)
        rows.append(bar(DAY0 + timedelta(days=i), p, p - 0.2, p + 1, p - 1, volume, symbol))
    return spark.createDataFrame(rows, SCHEMA)
