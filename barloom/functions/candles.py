"""The candle table: schema, keys, fixed sets, and the window of a series."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

SERIES = ["symbol", "exchange", "timeframe"]
KEY = [*SERIES, "timestamp"]
PRICES = ["open", "high", "low", "close"]
NUMBERS = [*PRICES, "volume"]

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in SERIES] + [T.StructField("timestamp", T.TimestampType())] + [T.StructField(c, T.DoubleType()) for c in NUMBERS])

#: Timeframes and their intervals in seconds.
SECONDS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800}

VALID, INSUFFICIENT, INVALID = "VALID", "INSUFFICIENT_DATA", "INVALID"


_parts: ContextVar[tuple[str, ...]] = ContextVar("parts of series", default=())


@contextmanager
def parts_of_series(*columns: str):
    """Windows that are built meanwhile see the rows of a series with the same ``columns`` alone."""
    token = _parts.set(columns)
    try:
        yield
    finally:
        _parts.reset(token)


def series() -> WindowSpec:
    """A series (or the part of it that ``parts_of_series`` names) in time order."""
    return Window.partitionBy(*SERIES, *_parts.get()).orderBy("timestamp")


def interval(timeframe: str = "timeframe") -> Column:
    """The seconds of a timeframe column; null for an unknown one."""
    return F.create_map(*[x for k, v in SECONDS.items() for x in (F.lit(k), F.lit(v).cast("long"))])[F.col(timeframe)]


def micros(column: str | Column) -> Column:
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)


def messages(*checks: tuple[Column, str | Column]) -> Column:
    """The messages whose condition holds, as an array (a null condition doesn't hold)."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(text) if isinstance(text, str) else text) for cond, text in checks]))


def finite(column: str) -> Column:
    """Not null, NaN or infinite.  Spark orders NaN above all numbers, so comparisons alone don't catch it."""
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def no_time(df, column: str = "timestamp"):
    """The column as a timestamp without zone, for outputs that other engines compare."""
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))
