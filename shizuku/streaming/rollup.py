"""Daily cells of a stream of readings: an extension, with the batch cube's rules for hours that end at midnight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(readings: DataFrame, delay: str = "1 day", hour_ending: bool = False) -> DataFrame:
    """place_id, variable_id, day, mean, min, max, n per calendar day of readings (place_id, variable_id, ts, value); rows later than `delay` are left out.

    With `hour_ending` a stamp ends its hour, so that midnight belongs to the day before.
    """
    ts = F.col("ts") - F.expr("INTERVAL 1 MICROSECOND") if hour_ending else F.col("ts")
    rows = readings.withColumn("at", ts).withWatermark("at", delay)
    cells = rows.groupBy("place_id", "variable_id", F.window("at", "1 day").alias("w")).agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))
    return cells.select("place_id", "variable_id", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "mean", "min", "max", "n")


def upsert_daily(cells: DataFrame, path: str, checkpoint: str):
    """Writes finished days; a repeated batch replaces itself, so restarts neither lose nor repeat days."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cells.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
