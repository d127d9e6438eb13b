"""Candle files: CSV and Parquet read into rows with their place (file and row number), parsed values and error texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barloom.functions.candles import NUMBERS, PRICES, SECONDS, SERIES, finite, messages

#: Accepted header names of each column.
ALIASES = {"timestamp": ("timestamp", "datetime", "date", "time"), **{c: (c,) for c in PRICES}, "volume": ("volume", "vol")}
#: An explicit zone only counts after a time of day, so the end of a bare date isn't taken for one.
ZONED = r"\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|z|[+-]\d{2}(:?\d{2})?)$"


def resolve(names: list[str], strip: bool) -> dict[str, str]:
    """Canonical name -> header name.  Of two headers with one normalised name the last wins; missing ones raise."""
    seen = {(n.strip() if strip else n).lower(): n for n in names}
    found = {c: next((seen[a] for a in options if a in seen), None) for c, options in ALIASES.items()}
    missing = [c for c, n in found.items() if n is None]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return found


def norm_keys(df: DataFrame) -> DataFrame:
    """Symbols and exchanges trimmed and in upper case, timeframes trimmed and in lower case."""
    return df.withColumns({"symbol": F.upper(F.trim("symbol")), "exchange": F.upper(F.trim("exchange")), "timeframe": F.lower(F.trim("timeframe"))})


def known_timeframe(column: str = "timeframe") -> Column:
    return F.coalesce(F.col(column).isin(list(SECONDS)), F.lit(False))


def in_zone(local: Column, zone: str) -> Column:
    """The instant at which clocks in ``zone`` show ``local`` (a timestamp without zone), whatever the session's zone.

    A time that a clock skips is read with the offset before the change, one that it shows twice as the first of both.
    """
    day = local.cast("date")
    return F.try_make_timestamp(F.year(day), F.month(day), F.day(day), F.hour(local), F.minute(local), F.date_part(F.lit("seconds"), local), F.lit(zone))


def norm_timestamp(raw: str | Column, kind: T.DataType, zone: str | None) -> Column:
    """An instant; null if the value can't be read, or has no zone and no ``zone`` is given.  The session's zone plays no part."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    if isinstance(kind, T.TimestampType):
        return raw
    none = F.lit(None).cast("timestamp")
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return in_zone(raw.cast("timestamp_ntz"), zone) if zone else none
    text = F.trim(raw.cast("string"))
    local = in_zone(text.try_cast("timestamp_ntz"), zone) if zone else none
    return F.when(text.rlike(ZONED), text.try_cast("timestamp")).otherwise(local)


def norm_number(raw: str | Column) -> Column:
    """A finite double, or null."""
    value = (F.trim((F.col(raw) if isinstance(raw, str) else raw).cast("string"))).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def parsed(raw: DataFrame, zone: str | None) -> DataFrame:
    """``seq``, keys, candle columns and ``errors`` (an array of texts, with the values that can't be read) from raw columns named canonically."""
    kinds = {f.name: f.dataType for f in raw.schema.fields}
    raws = {f"_raw_{c}": F.col(c).cast("string") for c in ("timestamp", *NUMBERS)}
    out = raw.withColumns(raws).withColumns({"timestamp": norm_timestamp("timestamp", kinds["timestamp"], zone), **{c: norm_number(c) for c in NUMBERS}})
    present = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull() & F.col("timestamp").isNotNull()
    told = lambda c: F.concat(F.lit(f"bad {c}: "), F.coalesce(F.col(f"_raw_{c}"), F.lit("null")))
    checks = [*[(F.col(c).isNull(), told(c)) for c in ("timestamp", *NUMBERS)], (~known_timeframe(), F.concat(F.lit("bad timeframe: "), F.coalesce("timeframe", F.lit("null"))))]
    return out.withColumn("errors", F.concat(messages(*checks), F.when(present & F.col("volume").isNotNull(), candle_errors()).otherwise(F.array().cast("array<string>")))).drop(*raws)


def candle_errors() -> Column:
    """Texts of the candle rules that a row breaks."""
    # The texts of the rules.
    o, h, l, c = (F.col(x) for x in PRICES)
    return messages(
        (F.col("timestamp").isNull(), "Timestamp must be timezone-aware"),
        (~(finite("open") & finite("high") & finite("low") & finite("close") & finite("volume")), "Values must be finite"),
        ((o <= 0) | (h <= 0) | (l <= 0) | (c <= 0), "All OHLC prices must be strictly positive"),
        (F.col("volume") < 0, "Volume cannot be negative"),
        ((h < o) | (h < c) | (h < l), "High price must be >= Open, Close, and Low"),
        ((l > o) | (l > c) | (l > h), "Low price must be <= Open, Close, and High"),
        (F.coalesce(F.trim("symbol"), F.lit("")) == "", "Symbol cannot be empty"),
        (F.coalesce(F.trim("exchange"), F.lit("")) == "", "Exchange cannot be empty"),
    )


def numbered(raw: DataFrame) -> DataFrame:
    """Rows of text files with ``_file`` and ``_row``, the number of the row in its file, from 1.

    A split's rows are read in order by one task, so a row's place in its split is the distance from the split's least
    id, and the rows of the splits before it come from a table with one row per split.
    """
    marked = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    splits = marked.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_base"))
    return marked.join(splits, ["_file", "_block"]).withColumn("_row", F.col("_id") + F.col("_base")).select(*[f"`{c}`" for c in raw.columns], "_file", "_row")


def _canonical(raw: DataFrame, strip: bool, keys: dict[str, str | None]) -> DataFrame:
    """Candle columns by alias, keys from arguments or else from columns of the file, ``file``, ``row`` and, of both, ``seq``."""
    names = [c for c in raw.columns if c not in ("_file", "_row")]
    found = resolve(names, strip)
    named = {(n.strip() if strip else n).lower(): n for n in names}
    key = {k: F.lit(v) if v is not None else F.col(f"`{named[k]}`") for k, v in keys.items()}
    place = [F.col("_file").alias("file"), F.col("_row").alias("row")]
    return raw.select(F.struct(*place).alias("seq"), *place, *[key[k].alias(k) for k in SERIES], *[F.col(f"`{n}`").alias(c) for c, n in found.items()])


def read_csv(spark: SparkSession, path: str, symbol: str | None = None, exchange: str | None = None, timeframe: str | None = None, zone: str | None = None) -> DataFrame:
    """Rows of CSV files with a header, every value read as text.  Blank lines are no rows."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    if not raw.columns:
        raise ValueError("the CSV file has no header")
    return parsed(norm_keys(_canonical(numbered(raw), True, {"symbol": symbol, "exchange": exchange, "timeframe": timeframe})), zone)


def read_parquet(spark: SparkSession, path: str, symbol: str | None = None, exchange: str | None = None, timeframe: str | None = None, zone: str | None = None) -> DataFrame:
    """Rows of Parquet files; header names compare in lower case, untrimmed."""
    raw = spark.read.parquet(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.row_index") + 1).alias("_row"))
    return parsed(norm_keys(_canonical(raw, False, {"symbol": symbol, "exchange": exchange, "timeframe": timeframe})), zone)


def error_texts(rows: DataFrame) -> DataFrame:
    """``file, row, text``: a text for each row that has errors, with its number in its file."""
    # Fixed value: the text around them.
    text = F.concat(F.lit("Row "), F.col("row").cast("string"), F.lit(" validation failure: "), F.array_join("errors", "; "))
    return rows.where(F.size("errors") > 0).select("file", "row", text.alias("text"))


def filter_range(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows between two aware datetimes, both included; either may be None."""
    for bound in (start, end):
        if bound is not None and bound.tzinfo is None:
            raise ValueError("range bounds need a time zone")
    if start is not None and end is not None and start > end:
        raise ValueError("the start is after the end")
    df = df.where(F.col("timestamp") >= F.lit(start)) if start is not None else df
    return df.where(F.col("timestamp") <= F.lit(end)) if end is not None else df
