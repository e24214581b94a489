"""Versioned rows: reading the current ones and merging changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.schemas import AUDIT, SCD


def current_rows(df: DataFrame) -> DataFrame:
    """Rows flagged current; a null flag counts as not current."""
    return df.where(F.col("is_current_flag"))


def current_versions(df: DataFrame) -> DataFrame:
    """Forecast rows of the version in force."""
    return df.where(F.col("is_current_version"))


def scd2_upsert(
    target: DataFrame,
    changes: DataFrame,
    key: Sequence[str],
    as_of: Column,
    user: str = "system",
    latest_by: Sequence[str] = (),
) -> DataFrame:
    """Close the current row of every changed key and append its new version.

    ``changes`` holds the business columns, one row per key. Several rows of one
    key raise unless ``latest_by`` names columns of ``changes`` whose greatest
    values win (then the greatest attributes). A key whose
    attributes are unchanged is left alone, and so is a key that the changes do
    not mention. Both sides are shuffled once, on the key; the closed history
    is passed through without a join.
    """
    lifecycle = {*SCD, *AUDIT}
    attributes = [c for c in target.columns if c not in lifecycle and c not in key]
    is_live = F.coalesce(F.col("is_current_flag"), F.lit(False))

    held = target.where(is_live).select(*key, F.struct(*target.columns).alias("_held"))
    business = F.struct(*key, *attributes)
    rank = F.struct(*latest_by, *attributes)
    picked = F.max_by(business, rank) if latest_by else F.any_value(business)
    repeated = F.lit("several changes of one key; name latest_by columns to pick one")
    incoming = changes.groupBy(*key).agg(picked.alias("_new"), F.count("*").alias("_rows")).select(
        *key,
        (F.col("_new") if latest_by else F.when(F.col("_rows") == 1, F.col("_new")).otherwise(
            F.raise_error(repeated))).alias("_new"),
    )
    same = F.lit(True)
    for name in attributes:
        same = same & F.col(f"_held.{name}").eqNullSafe(F.col(f"_new.{name}"))
    changed = F.col("_new").isNotNull() & (F.col("_held").isNull() | ~same)

    def row(source: str, overrides: dict[str, Column]) -> Column:
        return F.struct(
            *[
                overrides.get(f.name, F.col(f"{source}.{f.name}")).cast(f.dataType).alias(f.name)
                if f.name in overrides or f.name in (*key, *attributes) or source == "_held"
                else F.lit(None).cast(f.dataType).alias(f.name)
                for f in target.schema.fields
            ]
        )

    closing = {
        "valid_to_timestamp": as_of,
        "is_current_flag": F.lit(False),
        "updated_by_user": F.lit(user),
        "updated_timestamp": as_of,
    }
    kept = row(
        "_held",
        {c: F.when(changed, v).otherwise(F.col(f"_held.{c}")) for c, v in closing.items()},
    )
    opened = row(
        "_new",
        {
            "valid_from_timestamp": as_of,
            "is_current_flag": F.lit(True),
            "created_by_user": F.lit(user),
            "created_timestamp": as_of,
        },
    )
    merged = (
        held.join(incoming, list(key), "full")
        .select(
            F.explode(
                F.array_compact(
                    F.array(F.when(F.col("_held").isNotNull(), kept), F.when(changed, opened))
                )
            ).alias("_row")
        )
        .select("_row.*")
    )
    return target.where(~is_live).unionByName(merged)
