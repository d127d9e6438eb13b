"""Positions: average cost from fills, and valuation at the latest prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valuation(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Open positions (``symbol, quantity, average_price`` and any other columns) at each symbol's latest close of ``symbol, timestamp, close``.

    Without a positive price a position is worth its cost and has no gain.
    """
    latest = prices.groupBy("symbol").agg(F.max_by("close", "timestamp").alias("current_price"))
    held = positions.where("quantity > 0").join(latest, "symbol", "left").withColumn("current_price", F.coalesce("current_price", F.lit(0.0)))
    priced = F.col("current_price") > 0
    value = F.col("quantity") * F.when(priced, F.col("current_price")).otherwise(F.col("average_price"))
    gain = F.when(priced, (F.col("current_price") - F.col("average_price")) * F.col("quantity")).otherwise(0.0)
    return held.withColumn("market_value", value).withColumn("unrealized_pnl", gain)


#: Quantities are summed as decimals of so many places, so that a position that is sold out is at zero and not near it.
PLACES = 10


def average_cost(fills: DataFrame) -> DataFrame:
    """Per ``account, symbol``: quantity and average price after all fills (``seq, side, quantity, price``) in order of ``seq``.

    A buy averages its price in by quantity; a sell leaves the average; at zero or less the position is gone and the
    average starts anew.  A quantity that stops at zero is a running sum less its running minimum, in decimals of
    ``PLACES`` places (further places of a quantity are rounded; sums hold up to 28 digits before the point).  The average of the
    buys since the last stop is a sum of prices, each by its share at the time and by what later buys leave of it (a
    product, held as a sum of logarithms).  All of it runs in one sort per position, in windows that spill.
    """
    key = ["account", "symbol"]
    w = Window.partitionBy(*key).orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    buy = F.col("side") == "BUY"
    rows = fills.select(*key, "seq", buy.alias("buy"), F.col("quantity").cast(f"decimal(28,{PLACES})").alias("x"), F.col("price").cast("double").alias("price"))
    rows = rows.withColumn("sum", F.sum(F.when(F.col("buy"), F.col("x")).otherwise(-F.col("x"))).over(so_far))
    rows = rows.withColumn("held", F.col("sum") - F.least(F.min("sum").over(so_far), F.lit(0)))
    rows = rows.withColumn("before", F.coalesce(F.lag("held").over(w), F.lit(0)))
    grows = F.col("buy") & (F.col("held") > 0)
    x, held = F.col("x").cast("double"), F.col("held").cast("double")
    left = F.when(grows & (F.col("before") > 0), F.ln(F.col("before").cast("double") / held)).otherwise(0.0)
    rows = rows.withColumns({"stops": F.sum((~F.col("buy") & (F.col("held") <= 0)).cast("long")).over(so_far), "part": F.when(grows, F.col("price") * x / held).otherwise(0.0), "left": left})
    rows = rows.withColumns({"kept": F.sum("left").over(Window.partitionBy(*key)) - F.sum("left").over(so_far)})
    since = rows.groupBy(*key, "stops").agg(F.sum(F.col("part") * F.exp("kept")).alias("average_price"), F.max_by(F.col("held").cast("double"), "seq").alias("quantity"))
    last = since.groupBy(*key).agg(F.max_by(F.struct("quantity", "average_price"), "stops").alias("s"))
    return last.select(*key, "s.quantity", "s.average_price")


def open_positions(fills: DataFrame) -> DataFrame:
    """``average_cost`` without the positions that are sold out."""
    return average_cost(fills).where("quantity > 0")
