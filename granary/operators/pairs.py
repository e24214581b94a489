"""Combining two sides that share no key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def every_pair(left: DataFrame, right: DataFrame, slots: int | None = None) -> DataFrame:
    """Each left row with each right row, as an equi join on a spread slot.

    The left rows are spread evenly over ``slots``; the right side, which must
    be the shorter list, is repeated once per slot. Spark can then hash-join
    (broadcasting the right side only when its statistics allow) instead of
    running a nested loop.
    """
    if slots is None:
        slots = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = left.withColumn("_slot", F.pmod(F.xxhash64(*left.columns), F.lit(slots)).cast("int"))
    repeated = right.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return spread.join(repeated, "_slot").drop("_slot")
