"""Row and dataset checks: valid rows, duplicates, gaps, order, staleness, quality and coverage reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.candles import KEY, SERIES, finite, interval, messages, micros, series
from barloom.sources.files import candle_errors


def validate_candles(df: DataFrame) -> DataFrame:
    """Adds ``errors`` and ``is_valid``."""
    return df.withColumn("errors", candle_errors()).withColumn("is_valid", F.size("errors") == 0)


def _present(column: str, bad) -> F.Column:
    return F.col(column).isNotNull() & bad


def _flagged(df: DataFrame, *checks) -> DataFrame:
    return df.withColumn("errors", messages(*checks)).withColumn("is_valid", F.size("errors") == 0)


def _blank(column: str) -> F.Column:
    return F.coalesce(F.trim(column), F.lit("")) == ""


def validate_quotes(df: DataFrame) -> DataFrame:
    """Level-1 quotes: positive prices, sizes and volume not negative, bid not above ask."""
    return _flagged(
        df,
        (_blank("symbol"), "blank symbol"),
        (_blank("exchange"), "blank exchange"),
        (F.col("timestamp").isNull(), "no timestamp"),
        (F.coalesce(~(F.col("last_price") > 0), F.lit(True)), "last price must be positive"),
        (F.col("bid") <= 0, "bid must be positive"),
        (F.col("ask") <= 0, "ask must be positive"),
        ((F.col("bid_qty") < 0) | (F.col("ask_qty") < 0), "sizes must not be negative"),
        (F.col("volume") < 0, "volume must not be negative"),
        (F.col("bid") > F.col("ask"), "bid above ask"),
    )


def validate_ticks(df: DataFrame) -> DataFrame:
    """Trade prints: a positive price, quantities not negative."""
    return _flagged(
        df,
        (_blank("symbol"), "blank symbol"),
        (_blank("exchange"), "blank exchange"),
        (F.col("timestamp").isNull(), "no timestamp"),
        (F.coalesce(~(F.col("last_price") > 0), F.lit(True)), "last price must be positive"),
        (F.col("last_quantity") < 0, "last quantity must not be negative"),
        (F.col("total_volume") < 0, "total volume must not be negative"),
    )


def validate_instruments(df: DataFrame) -> DataFrame:
    """Reference rows: keys present, lot and tick sizes positive where given."""
    return _flagged(df, (_blank("symbol"), "blank symbol"), (_blank("exchange"), "blank exchange"), (F.col("lot_size") <= 0, "lot size must be positive"), (F.col("tick_size") <= 0, "tick size must be positive"))


def contract(earlier: F.Column) -> F.Column:
    """What a candle breaks of the contract of every indicator, as texts; ``earlier`` is the stamp before it in its series."""
    numbers = finite("open") & finite("high") & finite("low") & finite("close") & finite("volume")
    return messages(
        (F.col("timestamp").isNull(), "no timestamp"),
        (earlier >= F.col("timestamp"), "timestamps must ascend strictly"),
        (~numbers, "numbers must be finite"),
        (F.col("high") < F.col("low"), "high below low"),
        ((F.col("high") < F.col("open")) | (F.col("high") < F.col("close")), "high below open or close"),
        ((F.col("low") > F.col("open")) | (F.col("low") > F.col("close")), "low above open or close"),
        (F.col("volume") < 0, "negative volume"),
    )


def validate_series_strict(df: DataFrame, mode: str = "raise") -> DataFrame:
    """The contract of every indicator: ascending time without repeats in each series, finite numbers, consistent bars.

    ``mode="flag"`` returns the offending rows with ``violations``; ``mode="raise"`` returns ``df`` or raises.
    Order is that of ``seq`` if the table has it, otherwise only repeated stamps can break it.  Prices may be negative.
    """
    by = "seq" if "seq" in df.columns else "timestamp"
    rules = contract(F.lag("timestamp").over(Window.partitionBy(*SERIES).orderBy(by)))
    flagged = df.withColumn("violations", rules)
    if mode == "flag":
        return flagged.where(F.size("violations") > 0)
    seen = flagged.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("violations") > 0).alias("bad"), F.max("violations").alias("some")).first()
    if not seen["n"]:
        raise ValueError("no candles")
    if seen["bad"]:
        raise ValueError(f"{seen['bad']} candles break the series contract, such as: {seen['some']}")
    return df


def detect_duplicates(df: DataFrame) -> DataFrame:
    """Repeats of a candle key: ``first_seq`` and ``duplicate_seq`` with the key."""
    same = Window.partitionBy(*KEY)
    numbered = df.withColumn("_n", F.row_number().over(same.orderBy("seq"))).withColumn("first_seq", F.min("seq").over(same))
    return numbered.where("_n > 1").select(*KEY, "first_seq", F.col("seq").alias("duplicate_seq"))


def detect_gaps(df: DataFrame, seconds: float | None = None, factor: float = 1.0) -> DataFrame:
    """Neighbouring stamps of a series further apart than ``factor`` intervals (of the timeframe, unless ``seconds`` is given)."""
    allowed = (F.lit(float(seconds)) if seconds is not None else interval()) * factor * 1_000_000
    ahead = df.select(*KEY).withColumn("gap_end", F.lead("timestamp").over(series()))
    return ahead.where((allowed > 0) & (micros("gap_end") - micros("timestamp") > allowed)).select(*SERIES, F.col("timestamp").alias("gap_start"), "gap_end")


def check_ordering(df: DataFrame) -> DataFrame:
    """Neighbours in input order whose time falls."""
    w = Window.partitionBy(*SERIES).orderBy("seq")
    return df.withColumn("previous", F.lag("timestamp").over(w)).where("previous > timestamp").select(*SERIES, "seq", "previous", "timestamp")


def staleness(now: datetime, allowed_seconds: float) -> F.Column:
    """FRESH, STALE or FUTURE from a column ``latest``."""
    if now.tzinfo is None:
        raise ValueError("the current time needs a time zone")
    age = micros(F.lit(now)) - micros("latest")
    return F.when(age < 0, "FUTURE").when(age > allowed_seconds * 1_000_000, "STALE").otherwise("FRESH")


def check_staleness(df: DataFrame, now: datetime, allowed_seconds: float) -> DataFrame:
    """Per series the latest stamp, its age in seconds and its status."""
    latest = df.groupBy(*SERIES).agg(F.max("timestamp").alias("latest"))
    return latest.withColumn("age_seconds", (micros(F.lit(now)) - micros("latest")) / 1_000_000).withColumn("status", staleness(now, allowed_seconds))


def quality_report(df: DataFrame, seconds: float | None = None, now: datetime | None = None, allowed_seconds: float | None = None, requested: DataFrame | None = None, samples: int = 5) -> DataFrame:
    """One row per series: status, counts by check, a bounded sample of error texts, the checks that ran.

    Needs ``seq``, the input order.  Gaps count only where the order is right and nothing repeats.  Series of
    ``requested`` without candles are INSUFFICIENT_DATA.
    """
    w_in, w_key = Window.partitionBy(*SERIES).orderBy("seq"), Window.partitionBy(*KEY).orderBy("seq")
    allowed = (F.lit(float(seconds)) if seconds is not None else interval()) * 1_000_000
    rows = df.withColumns({"_bad": candle_errors(), "_repeat": (F.row_number().over(w_key) > 1).cast("int")})
    before = F.lag("timestamp").over(w_in)
    rows = rows.withColumns({"_fell": (before > F.col("timestamp")).cast("int"), "_gap": (micros("timestamp") - micros(before) > allowed).cast("int")})
    gap = F.sum(F.coalesce("_gap", F.lit(0)))
    out = rows.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.sum(F.size("_bad")).cast("long").alias("candle_errors"),
        F.coalesce(F.sum("_fell"), F.lit(0)).alias("ordering_errors"),
        F.sum("_repeat").alias("duplicates"),
        gap.alias("_gaps"),
        F.max("timestamp").alias("latest"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_bad")))), 1, samples).alias("errors"),
    )
    if requested is not None:
        out = requested.select(*SERIES).distinct().join(out, SERIES, "left")
    out = out.withColumn("record_count", F.coalesce("record_count", F.lit(0)))
    out = out.withColumn("gaps", F.when((F.col("ordering_errors") == 0) & (F.col("duplicates") == 0), F.col("_gaps")).otherwise(F.lit(0)))
    aged = F.lit("FRESH") if now is None or allowed_seconds is None else staleness(now, allowed_seconds)
    failed = (F.col("candle_errors") + F.col("ordering_errors") + F.col("duplicates") > 0) | (aged == "FUTURE")
    status = F.when(F.col("record_count") == 0, "INSUFFICIENT_DATA").when(failed, "INVALID").when(aged == "STALE", "STALE").when(F.col("gaps") > 0, "WARNING").otherwise("VALID")
    checks = ["data_sufficiency", "candle_integrity", "chronological_ordering", "duplicate_detection", "gap_detection"] + ["staleness_check"] * (now is not None and allowed_seconds is not None)
    return out.withColumn("status", status).withColumn("checks_run", F.array(*[F.lit(c) for c in checks])).drop("_gaps", "latest")


def coverage_report(df: DataFrame, factor: float = 1.5, samples: int = 20) -> DataFrame:
    """Per series: records, first and last stamp, how many gaps of over ``factor`` intervals, and the first few as text."""
    before = F.lag("timestamp").over(series())
    gap = micros("timestamp") - micros("before") > interval() * factor * 1_000_000
    rows = df.select(*KEY).withColumn("before", before).withColumn("_gap", F.coalesce(gap, F.lit(False)))
    text = F.when(F.col("_gap"), F.concat_ws(" -> ", F.date_format("before", "yyyy-MM-dd HH:mm:ss"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")))
    # the texts of a series' first gaps only, so no row gathers all of them
    rows = rows.withColumn("_k", F.sum(F.col("_gap").cast("int")).over(series())).withColumn("_text", F.when(F.col("_k") <= samples, text))
    return rows.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.min("timestamp").alias("earliest"),
        F.max("timestamp").alias("latest"),
        F.count_if("_gap").alias("potential_gap_count"),
        F.array_sort(F.collect_list("_text")).alias("gap_details"),
    ).withColumn("has_potential_gaps", F.col("potential_gap_count") > 0)
