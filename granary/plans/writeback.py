"""Changing forecasts: new versions, scenario copies, bulk adjustments.

Every function returns the complete new table as a lazy DataFrame, so that the
caller writes a new snapshot and never overwrites what is being read. The rows
that stay as they are pass through without a shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.constants import ADJUST_PCT_RANGE, ADJUST_UNITS_RANGE
from granary.functions.calendar import in_quarter
from granary.functions.numbers import dec
from granary.operators.keys import dense_ids, next_id
from granary.plans.lines import LEAF_LEVEL, category_names, forecast_lines
from granary.operators.current import current_rows
from granary.schemas import columns_of
from granary.sources.tables import PlanningTables

# What an element of the JSON payload may carry, and the type it is read as.
UPDATE_FIELDS = {
    "product_id": "bigint",
    "site_id": "bigint",
    "forecast_date": "date",
    "forecast_quantity": "decimal(18,4)",
    "forecast_type": "string",
    "forecast_method": "string",
    "forecast_horizon": "string",
    "confidence_level": "decimal(5,2)",
    "fiscal_period": "string",
    "fiscal_month": "string",
    "fiscal_quarter": "string",
    "fiscal_year": "bigint",
    "unit_revenue": "decimal(18,4)",
}
UPDATE_DEFAULTS = {
    "forecast_type": "DEMAND",
    "forecast_method": "MANUAL_ADJUSTMENT",
    "forecast_horizon": "MONTHLY",
}
_FIRST = ("product_id", "site_id", "forecast_date", "forecast_quantity", "unit_revenue")
# All columns, so that only equal lines can tie.
_ID_ORDER = (*_FIRST, *(n for n in UPDATE_FIELDS if n not in _FIRST))


class VersionChange(NamedTuple):
    """A new forecast table with the one-row receipt of the change."""

    forecasts: DataFrame
    receipt: DataFrame


class ScenarioCopy(NamedTuple):
    """New scenario and forecast tables with the one-row receipt."""

    scenarios: DataFrame
    forecasts: DataFrame
    receipt: DataFrame


def parse_updates(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Rows of a JSON array column, one per element, typed strictly.

    Keys are upper case. Malformed JSON and values of the wrong type raise, a
    missing key or a JSON null is null, a null element is a row of nulls; a null
    payload or an empty array gives no row. Each payload is parsed once, to text
    fields that are then cast.
    """
    element = ", ".join(f"{name.upper()} string" for name in UPDATE_FIELDS)
    parsed = F.from_json(column, f"array<struct<{element}>>", {"mode": "FAILFAST"})
    # The outer form keeps Spark from parsing twice, once to see whether there is
    # anything to explode.
    elements = payloads.select(F.posexplode_outer(parsed).alias("place", "element")).where(
        F.col("place").isNotNull()
    )

    def typed(name: str, kind: str) -> Column:
        text = F.col(f"element.{name.upper()}")
        return (text.cast("decimal(38,0)") if kind == "bigint" else text).cast(kind)

    return elements.select(*[typed(n, k).alias(n) for n, k in UPDATE_FIELDS.items()])


def _shape(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Forecast rows in table order from columns, overrides and nulls."""
    return df.select(
        *[
            (values[n] if n in values else F.col(n) if n in df.columns else F.lit(None))
            .cast(kind)
            .alias(n)
            for n, kind in columns_of("demand_forecast_versions").items()
        ]
    )


def _receipt(df: DataFrame, **fields: Column) -> DataFrame:
    one = df.sparkSession.range(1)
    return one.select(*[value.alias(name) for name, value in fields.items()])


def submit_forecast_version(
    forecasts: DataFrame,
    updates: DataFrame,
    scenario_id: int,
    user: str,
    as_of: Column,
    numeric: str = "scale0",
) -> VersionChange:
    """Supersede the scenario's current rows and append the submitted ones.

    ``updates`` holds :data:`UPDATE_FIELDS` (from :func:`parse_updates` or any
    table). Under ``scale0`` the revenue uses the quantity rounded to a whole
    number, as the reference does; ``declared`` multiplies it as stored.
    """
    if numeric not in ("scale0", "declared"):
        raise ValueError(f"numeric must be 'scale0' or 'declared', not {numeric!r}")
    retired = (F.col("scenario_id") == scenario_id) & F.coalesce(
        F.col("is_current_version"), F.lit(False)
    )
    old = forecasts.withColumns(
        {
            "is_current_version": F.when(retired, False).otherwise(F.col("is_current_version")),
            "updated_by_user": F.when(retired, user).otherwise(F.col("updated_by_user")),
            "updated_timestamp": F.when(retired, as_of).otherwise(F.col("updated_timestamp")),
        }
    )
    counted = F.col("forecast_quantity")
    if numeric == "scale0":
        counted = counted.cast("decimal(38,0)").cast("decimal(18,0)")
    rows = updates.select(
        *[
            F.coalesce(F.col(n), F.lit(UPDATE_DEFAULTS[n])).alias(n)
            if n in UPDATE_DEFAULTS
            else F.col(n).cast(kind).alias(n)
            for n, kind in UPDATE_FIELDS.items()
        ]
    )
    numbered = dense_ids(
        rows, _ID_ORDER, "demand_forecast_id", next_id(forecasts, "demand_forecast_id")
    )
    new = _shape(
        numbered,
        {
            "scenario_id": F.lit(scenario_id),
            "forecast_creation_date": as_of,
            "total_revenue": counted * F.col("unit_revenue"),
            "version_timestamp": as_of,
            "is_current_version": F.lit(True),
            "created_by_user": F.lit(user),
            "created_timestamp": as_of,
        },
    )
    receipt = _receipt(
        forecasts,
        status=F.lit("SUCCESS"),
        rows_superseded=forecasts.where(retired).agg(F.count("*")).scalar(),
        rows_inserted=numbered.agg(F.count("*")).scalar(),
        scenario_id=F.lit(scenario_id).cast("bigint"),
        version_timestamp=as_of,
        submitted_by=F.lit(user),
    )
    return VersionChange(old.unionByName(new), receipt)


def create_scenario_copy(
    scenarios: DataFrame,
    forecasts: DataFrame,
    source_id: int,
    code: str,
    name: str,
    user: str,
    as_of: Column,
    description: str | None = None,
    mode: str = "full",
) -> ScenarioCopy:
    """A new custom scenario holding a copy of another one's current rows.

    ``mode="full"`` copies every forecast column and records the parent; a
    missing source adds nothing. ``mode="ui_minimal"`` copies product, site,
    date and quantity only, marks the rows ``Copied`` and records no parent.
    """
    if mode not in ("full", "ui_minimal"):
        raise ValueError(f"mode must be 'full' or 'ui_minimal', not {mode!r}")
    full = mode == "full"
    session = scenarios.sparkSession
    new_id = next_id(scenarios, "scenario_id") + 1
    source = scenarios.where(F.col("scenario_id") == source_id)
    basis = source if full else session.range(1).withColumn("scenario_name", F.lit(None))
    about = F.lit(description)
    if full and description is None:
        about = F.concat(F.lit("Copy of "), F.col("scenario_name"))
    values = {
        "scenario_id": new_id,
        "scenario_code": F.lit(code),
        "scenario_name": F.lit(name),
        "scenario_description": about,
        "scenario_type": F.lit("CUSTOM"),
        "is_official_baseline": F.lit(False),
        "version_number": F.lit(1),
        "parent_scenario_id": F.lit(source_id if full else None),
        "created_by_user": F.lit(user),
        "created_timestamp": as_of,
    }
    added = basis.select(
        *[
            values.get(n, F.lit(None)).cast(kind).alias(n)
            for n, kind in columns_of("scenario_definition").items()
        ]
    )
    copied = forecasts.where(
        (F.col("scenario_id") == source_id) & F.col("is_current_version")
    ).withColumnRenamed("demand_forecast_id", "_source_id")
    if not full:
        copied = copied.select(
            "_source_id", "product_id", "site_id", "forecast_date", "forecast_quantity"
        ).withColumn("forecast_type", F.lit("Copied"))
    numbered = dense_ids(
        copied, ("_source_id",), "demand_forecast_id", next_id(forecasts, "demand_forecast_id")
    )
    fresh = {
        "scenario_id": new_id,
        "version_timestamp": as_of,
        "is_current_version": F.lit(True),
        "created_by_user": F.lit(user),
        "created_timestamp": as_of,
        "updated_by_user": F.lit(None),
        "updated_timestamp": F.lit(None),
    }
    if full:
        fresh["forecast_creation_date"] = as_of
    receipt = _receipt(
        forecasts,
        status=F.lit("SUCCESS"),
        new_scenario_id=new_id,
        new_scenario_code=F.lit(code),
        source_scenario_id=F.lit(source_id).cast("bigint"),
        forecasts_copied=numbered.agg(F.count("*")).scalar(),
        created_by=F.lit(user),
    )
    return ScenarioCopy(
        scenarios.unionByName(added), forecasts.unionByName(_shape(numbered, fresh)), receipt
    )


def receipt_json(receipt: DataFrame) -> DataFrame:
    """A receipt as one JSON object."""
    return receipt.select(F.to_json(F.struct("*")).alias("receipt"))


def _check_adjustment(pct: float | None, units: float | None) -> None:
    if (pct is None) == (units is None):
        raise ValueError("give exactly one of pct and units")
    low, high = ADJUST_PCT_RANGE if units is None else ADJUST_UNITS_RANGE
    value = pct if units is None else units
    if not low <= value <= high:
        raise ValueError(f"adjustment {value} is outside {low}..{high}")


def _factor(pct: float) -> Column:
    return (dec("1") + dec(str(pct), "decimal(9,4)") / 100).cast("decimal(9,6)")


def adjust_forecast(
    t: PlanningTables,
    scenario_id: int,
    user: str,
    as_of: Column,
    pct: float | None = None,
    units: float | None = None,
    quarter: str | None = None,
    category: str | None = None,
    site_id: int | None = None,
    recompute_revenue: bool = False,
) -> DataFrame:
    """Scale or shift the current quantities of one scenario.

    The official baseline is read-only. ``category`` and ``site_id`` narrow the
    change; the reference offers both filters but applies neither, so leaving
    them out matches it. Revenue stays as stored unless asked otherwise. Only the
    scenario's current rows meet the products; all others pass through.
    """
    _check_adjustment(pct, units)
    official = t.scenario_definition.where(
        (F.col("scenario_id") == scenario_id) & F.col("is_official_baseline")
    )
    if not official.isEmpty():
        raise ValueError(f"scenario {scenario_id} is the official baseline and read-only")

    forecasts = t.demand_forecast_versions
    hit = (F.col("scenario_id") == scenario_id) & F.coalesce(
        F.col("is_current_version"), F.lit(False)
    )
    if quarter is not None:
        hit = hit & in_quarter(F.col("forecast_date"), quarter)
    if site_id is not None:
        hit = hit & (F.col("site_id") == site_id)
    hit = F.coalesce(hit, F.lit(False))
    untouched, lines = forecasts.where(~hit), forecasts.where(hit)
    member = F.lit(True)
    if category is not None:
        members = (
            current_rows(t.product)
            .join(category_names(t.product_category, LEAF_LEVEL), "product_category_id")
            .where(F.col("product_family") == category)
            .select("product_id", F.lit(True).alias("_member"))
            .distinct()
        )
        lines = lines.join(members, "product_id", "left")
        member = F.coalesce(F.col("_member"), F.lit(False))

    quantity = F.col("forecast_quantity")
    moved = quantity * _factor(pct) if units is None else quantity + dec(str(units))
    changes = {
        "forecast_quantity": F.when(member, moved.cast("decimal(18,4)")).otherwise(quantity),
        "updated_by_user": F.when(member, user).otherwise(F.col("updated_by_user")),
        "updated_timestamp": F.when(member, as_of).otherwise(F.col("updated_timestamp")),
    }
    if recompute_revenue:
        revenue = (moved.cast("decimal(18,4)") * F.col("unit_revenue")).cast("decimal(18,2)")
        changes["total_revenue"] = F.when(member, revenue).otherwise(F.col("total_revenue"))
    return untouched.unionByName(lines.withColumns(changes).select(*forecasts.columns))


def preview_adjustment(
    t: PlanningTables,
    scenario_id: int,
    pct: float | None = None,
    units: float | None = None,
    quarter: str | None = None,
    per_row: bool = False,
    cost_grain: str = "zone",
) -> DataFrame:
    """Current and projected totals per quarter over the comparison rows.

    The reference adds an absolute change once per quarter here although
    applying it adds to every row; ``per_row=True`` previews what is applied.
    """
    _check_adjustment(pct, units)
    lines = forecast_lines(t, cost_grain=cost_grain).where(F.col("scenario_id") == scenario_id)
    if quarter is not None:
        lines = lines.where(F.col("fiscal_quarter") == quarter)
    totals = lines.groupBy("fiscal_quarter").agg(
        F.sum("copies").alias("affected_rows"),
        F.sum(F.col("forecast_quantity") * F.col("copies")).alias("current_total"),
    )
    current = F.col("current_total")
    if units is None:
        projected = current * _factor(pct)
    else:
        times = F.col("affected_rows") if per_row else F.lit(1)
        projected = current + dec(str(units)) * times
    return totals.withColumn("projected_total", projected.cast("decimal(34,4)"))


def preview_totals(preview: DataFrame) -> DataFrame:
    """One row: totals over the preview and the change in percent."""
    sums = preview.agg(
        F.sum("current_total").cast("double").alias("current_total"),
        F.sum("projected_total").cast("double").alias("projected_total"),
    )
    old, new = F.col("current_total"), F.col("projected_total")
    return sums.withColumn(
        "change_pct", F.when(old > 0, F.round((new - old) / old * 100, 2)).otherwise(F.lit(0.0))
    )
