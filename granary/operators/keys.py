"""Dense surrogate keys without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from granary.operators.durable import durable

_LOCAL_BITS = 33


def next_id(df: DataFrame, column: str) -> Column:
    """Highest key in use (0 for an empty table) as a scalar subquery."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).cast("bigint")).scalar()


def _before(window: WindowSpec, column: str) -> Column:
    """Sum of a column over the earlier rows of a window."""
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0))


def _in_order(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The rows in global order, checkpointed: partition ``_part``, place ``_row`` in it."""
    mask = F.lit((1 << _LOCAL_BITS) - 1)
    return durable(
        df.repartitionByRange(*[F.col(c) for c in order_by])
        .sortWithinPartitions(*order_by)
        .withColumn("_place", F.monotonically_increasing_id())
    ).select(
        "*",
        F.shiftright("_place", _LOCAL_BITS).cast("int").alias("_part"),
        F.col("_place").bitwiseAND(mask).alias("_row"),
    ).drop("_place")


def _offsets(placed: DataFrame, rows: Column) -> DataFrame:
    """How many rows the partitions before each one have; one row per partition."""
    sizes = placed.groupBy("_part").agg(rows.alias("_rows"))
    return sizes.select("_part", _before(Window.orderBy("_part"), "_rows").alias("_before"))


def dense_ids(
    df: DataFrame,
    order_by: Sequence[str],
    name: str,
    start: Column | int = 0,
    store: str = "rows",
) -> DataFrame:
    """Number the rows ``start + 1, start + 2, ...`` in the given order.

    What is numbered is range-partitioned and sorted, so a hot leading key
    spreads over several partitions as long as the later columns differ, and
    checkpointed, which pins the sampled partition bounds; each partition then
    adds the row counts of the partitions before it. The offset table has one
    row per partition, whatever the data size.

    ``store="rows"`` checkpoints the rows: right where they are about as narrow
    as their keys or dear to compute. ``store="keys"`` checkpoints the distinct
    keys and their counts alone; the rows, texts say, meet their key's first
    number and are never stored. It evaluates ``df`` twice, whose keys must come
    out the same; rows of one key follow one another in the order of a hash of
    their values, and equal rows are interchangeable. Either way a task that is
    run again gives the same numbers.
    """
    if store not in ("rows", "keys"):
        raise ValueError(f"store must be 'rows' or 'keys', not {store!r}")
    begin = start if isinstance(start, Column) else F.lit(start)
    if store == "rows":
        placed = _in_order(df, order_by)
        return (
            placed.join(F.broadcast(_offsets(placed, F.count("*"))), "_part")
            .withColumn(name, (begin + F.col("_before") + F.col("_row") + 1).cast("bigint"))
            .drop("_part", "_before", "_row")
        )
    # One struct, so that null parts are equal and join and window share a shuffle.
    keyed = df.withColumn("_key", F.struct(*[F.col(c) for c in order_by]))
    placed = _in_order(keyed.groupBy("_key").agg(F.count("*").alias("_times")), ["_key"])
    inside = _before(Window.partitionBy("_part").orderBy("_row"), "_times")
    first = (
        placed.withColumn("_inside", inside)
        .join(F.broadcast(_offsets(placed, F.sum("_times"))), "_part")
        .select("_key", (F.col("_before") + F.col("_inside")).alias("_first"))
    )
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    among = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64(*plain)))
    return (
        keyed.join(first, "_key")
        .withColumn(name, (begin + F.col("_first") + among).cast("bigint"))
        .drop("_key", "_first")
    )
