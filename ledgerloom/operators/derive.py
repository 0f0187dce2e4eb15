"""Rebuildable derived views: leaders, histograms, series, rolling sums, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_by_volume(outputs: DataFrame, n: int = 100, key: str = "address") -> DataFrame:
    """The ``n`` addresses that received most; ties go to the smaller address."""
    sums = outputs.groupBy(key).agg(F.sum("value_zat").alias("volume_zat"), F.count("*").alias("n_outputs"))
    return sums.orderBy(F.desc("volume_zat"), key).limit(n)


def value_histogram(outputs: DataFrame) -> DataFrame:
    """Outputs by powers of ten of their value."""
    digits = F.length(F.col("value_zat").cast("string")).cast("bigint")
    return outputs.groupBy(digits.alias("digits")).agg(F.count("*").alias("n_outputs"), F.sum("value_zat").alias("value_zat"))


def per_hour(events: DataFrame, time: str = "ts") -> DataFrame:
    """Events and their value by type and hour (tumbling windows)."""
    hour = F.date_trunc("hour", F.col(time))
    return events.groupBy(hour.alias("hour_start"), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("value"))


def rolling(events: DataFrame, hours: int = 24, time: str = "ts") -> DataFrame:
    """Hourly counts with the count of the last ``hours`` hours. Each hour is sent to the windows that hold it, so the
    sum is an aggregate by hour and not a window over the whole series."""
    hourly = events.groupBy(F.date_trunc("hour", F.col(time)).alias("hour_start")).agg(F.count("*").alias("n_events"))
    spread = hourly.select(F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("later"), "hour_start", "n_events")
    sums = spread.groupBy((F.col("hour_start") + F.make_dt_interval(hours="later")).alias("hour_start")).agg(F.sum("n_events").alias("n_rolling"))
    return hourly.join(sums, "hour_start")


def sessions(events: DataFrame, gap_minutes: int = 30, key: str = "user_id", time: str = "ts") -> DataFrame:
    """Runs of a user's events with no gap of ``gap_minutes`` or more."""
    span = F.session_window(F.col(time), f"{gap_minutes} minutes")
    grouped = events.groupBy(key, span.alias("span")).agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("value"))
    return grouped.select(key, F.col("span.start").alias("session_start"), "n_events", "value")


def address_activity(history: DataFrame, key: str = "address") -> DataFrame:
    """First and last active height, active heights and totals of each address."""
    return history.groupBy(key).agg(F.min("height").alias("first_height"), F.max("height").alias("last_height"), F.count("*").alias("n_heights"), F.sum("received_zat").alias("received_zat"), F.sum("spent_zat").alias("spent_zat"))


def running_balance(history: DataFrame, key: str = "address") -> DataFrame:
    """Balance of each address after each height at which it moved."""
    before = Window.partitionBy(key).orderBy("height").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return history.select(key, "height", F.sum(F.col("received_zat") - F.col("spent_zat")).over(before).alias("balance_zat"))


def running_sums(rows: DataFrame, order: str, columns: list[str], block: int = 1000) -> DataFrame:
    """Running totals of ``columns`` over the ledger's order without one task that sees all rows: sums inside blocks of
    ``block`` heights, then a running sum over the block totals (one row for each), then both together."""
    part = F.floor(F.col(order) / block)
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("_part", part).select("*", *[F.sum(c).over(inside).alias(f"_{c}") for c in columns])
    totals = rows.groupBy(part.alias("_part")).agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_part", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns])
    return local.join(carried, "_part").select(order, *[(F.col(f"_{c}") + F.col(f"_b_{c}")).alias(c) for c in columns])
