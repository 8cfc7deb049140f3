"""Ties between people and time slots as a stream, for events that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slot_sizes(events: DataFrame, minutes: int = 60, late: str = "2 hours", time: str = "ts", person: str = "user_id") -> DataFrame:
    """(slot, n_ties, n_people) for each closed slot of a stream; events later than ``late`` are dropped.

    The number of people is approximate, as an exact one would keep every person of an open slot as state.
    """
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    found = stamped.groupBy(F.window(time, f"{minutes} minutes").alias("slot")).agg(F.count("*").alias("n_ties"), F.approx_count_distinct(person).alias("n_people"))
    return found.select(F.col("slot.start").alias("slot"), "n_ties", "n_people")
