"""Named metrics, dimensions and filters over the comparison and KPI tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.numbers import storage_cost
from granary.plans.lines import forecast_lines, weighted_avg, weighted_sum
from granary.plans.mart import scenario_comparison, scenario_kpis
from granary.sources.tables import PlanningTables

_RATE = "storage_cost_per_pallet_per_day"


def _storage() -> Column:
    return storage_cost(F.col("forecast_quantity"), F.col(_RATE))


@dataclass(frozen=True)
class Metric:
    """An aggregate over weighted lines and the cost columns it reads."""

    build: Callable[[], Column]
    cost_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class TableModel:
    """What may be asked of one table; every name resolves case-insensitively."""

    dimensions: tuple[str, ...]
    time_dimensions: tuple[str, ...]
    facts: tuple[str, ...]
    metrics: Mapping[str, Metric] = field(default_factory=dict)
    filters: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    synonyms: Mapping[str, str] = field(default_factory=dict)

    def resolve(self, name: str, kinds: Iterable[Iterable[str]], what: str) -> str:
        """The canonical name behind a name or synonym; unknown names raise."""
        allowed = [n for kind in kinds for n in kind]
        wanted = name.strip().lower()
        by_name = {n.lower(): n for n in allowed}
        if wanted in by_name:
            return by_name[wanted]
        targets = [v for k, v in self.synonyms.items() if k.lower() == wanted and v in allowed]
        if targets:
            return targets[0]
        raise KeyError(f"unknown {what} {name!r}")

    def with_filter(self, name: str, build: Callable[[], Column]) -> TableModel:
        """The same model with a named filter added or replaced."""
        return replace(self, filters={**self.filters, name: build})


COMPARISON = TableModel(
    dimensions=(
        "scenario_id",
        "scenario_code",
        "scenario_name",
        "scenario_type",
        "is_official_baseline",
        "product_id",
        "product_code",
        "product_name",
        "product_family",
        "site_id",
        "site_code",
        "site_name",
        "site_type",
        "region",
        "forecast_type",
    ),
    time_dimensions=("forecast_date", "fiscal_month", "fiscal_quarter", "fiscal_period"),
    facts=(
        "forecast_quantity",
        "unit_revenue",
        "total_revenue",
        "unit_cost",
        "total_cost",
        "gross_margin",
        "projected_warehousing_cost",
        "overflow_penalty_rate",
        "confidence_level",
    ),
    metrics={
        "total_forecasted_revenue": Metric(lambda: weighted_sum(F.col("total_revenue"))),
        "total_forecasted_quantity": Metric(lambda: weighted_sum(F.col("forecast_quantity"))),
        "total_warehousing_cost": Metric(lambda: weighted_sum(_storage()), (_RATE,)),
        "total_gross_margin": Metric(lambda: weighted_sum(F.col("gross_margin"))),
        "gross_margin_percentage": Metric(
            lambda: weighted_sum(F.col("gross_margin")).cast("double")
            / F.nullif(weighted_sum(F.col("total_revenue")).cast("double"), F.lit(0.0))
            * 100
        ),
        "average_confidence": Metric(lambda: weighted_avg(F.col("confidence_level"))),
        "net_margin_after_warehousing": Metric(
            lambda: weighted_sum(F.col("gross_margin")) - weighted_sum(_storage()), (_RATE,)
        ),
    },
    filters={
        "q4_only": lambda: F.col("fiscal_quarter") == "Q4",
        "q3_only": lambda: F.col("fiscal_quarter") == "Q3",
        "baseline_only": lambda: F.col("scenario_code") == "BASELINE",
        "q4_push_only": lambda: F.col("scenario_code") == "Q4_PUSH",
        "northeast_only": lambda: F.col("region") == "Northeast",
        "october_only": lambda: F.col("fiscal_month") == "October",
    },
    # The other names users know the columns by.
    synonyms={
        "scenario": "scenario_code",
        "plan code": "scenario_code",
        "plan name": "scenario_name",
        "forecast plan": "scenario_name",
        "sku": "product_code",
        "item code": "product_code",
        "product": "product_name",
        "item": "product_name",
        "category": "product_family",
        "product category": "product_family",
        "family": "product_family",
        "warehouse": "site_name",
        "distribution center": "site_name",
        "DC": "site_name",
        "area": "region",
        "territory": "region",
        "date": "forecast_date",
        "period date": "forecast_date",
        "month": "fiscal_month",
        "quarter": "fiscal_quarter",
        "quantity": "forecast_quantity",
        "units": "forecast_quantity",
        "demand units": "forecast_quantity",
        "price": "unit_revenue",
        "unit price": "unit_revenue",
        "revenue": "total_revenue",
        "sales": "total_revenue",
        "cost": "unit_cost",
        "cogs": "total_cost",
        "cost of goods": "total_cost",
        "margin": "gross_margin",
        "profit": "gross_margin",
        "warehousing cost": "projected_warehousing_cost",
        "storage cost": "projected_warehousing_cost",
        "warehouse cost": "projected_warehousing_cost",
        "total revenue": "total_forecasted_revenue",
        "sum revenue": "total_forecasted_revenue",
        "total units": "total_forecasted_quantity",
        "sum quantity": "total_forecasted_quantity",
        "total storage cost": "total_warehousing_cost",
        "warehousing budget": "total_warehousing_cost",
        "total margin": "total_gross_margin",
        "total profit": "total_gross_margin",
        "margin percent": "gross_margin_percentage",
        "margin %": "gross_margin_percentage",
        "net margin": "net_margin_after_warehousing",
        "adjusted margin": "net_margin_after_warehousing",
        "Q4": "q4_only",
        "fourth quarter": "q4_only",
        "Q3": "q3_only",
        "third quarter": "q3_only",
        "marketing push": "q4_push_only",
        "Q4 push": "q4_push_only",
        "northeast": "northeast_only",
        "NE": "northeast_only",
        "northeast DC": "northeast_only",
        "october": "october_only",
        "oct": "october_only",
    },
)

KPI = TableModel(
    dimensions=("scenario_id", "scenario_code", "scenario_name"),
    time_dimensions=(),
    facts=(
        "product_count",
        "site_count",
        "total_forecast_quantity",
        "total_forecasted_revenue",
        "total_forecasted_cost",
        "total_gross_margin",
        "gross_margin_pct",
        "total_warehousing_cost",
        "net_margin_after_storage",
    ),
    synonyms={"scenario": "scenario_code", "plan": "scenario_code"},
)

MODELS: Mapping[str, TableModel] = {"scenario_comparison": COMPARISON, "scenario_kpi": KPI}


def metric_query(
    t: PlanningTables,
    table: str = "scenario_comparison",
    metrics: Sequence[str] = (),
    dims: Sequence[str] = (),
    filters: Sequence[str | Column] = (),
    facts: Sequence[str] = (),
    models: Mapping[str, TableModel] = MODELS,
    cost_grain: str = "zone",
    order: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Metrics by dimensions, or the raw facts of a table.

    Metrics of the comparison are computed over weighted lines, and the cost
    columns that split a forecast into several lines are joined only when a metric
    reads them; those of another table over its own rows. Facts are row values and
    cannot be mixed with metrics. ``order`` names asked columns or their synonyms,
    with `` desc`` behind those that fall; nulls sort last when rising and first
    when falling. ``limit`` keeps the first rows of that order, as a top-k that
    never sorts all rows in one task, and needs one.
    """
    if table not in models:
        raise KeyError(f"unknown table {table!r}")
    model = models[table]
    axes = (model.dimensions, model.time_dimensions)
    columns = [model.resolve(d, axes, "dimension") for d in dims]
    measures = [model.resolve(m, (model.metrics,), "metric") for m in metrics]
    values = [model.resolve(f, (model.facts,), "fact") for f in facts]
    if bool(measures) == bool(values):
        raise ValueError("ask for metrics or for facts")
    conditions = [
        f
        if isinstance(f, Column)
        else model.filters[model.resolve(f, (model.filters,), "filter")]()
        for f in filters
    ]

    keys = [_sort_key(o, columns, [*measures, *values], model) for o in order]
    if limit is not None and not keys:
        raise ValueError("a limit needs an order")

    def arranged(found: DataFrame) -> DataFrame:
        found = found.orderBy(*keys) if keys else found
        return found if limit is None else found.limit(limit)

    if measures and table == "scenario_comparison":
        needed = sorted({c for m in measures for c in model.metrics[m].cost_columns})
        rows = forecast_lines(t, needed, cost_grain)
    elif table == "scenario_kpi":
        rows = scenario_kpis(t, cost_grain)
    else:
        rows = scenario_comparison(t, cost_grain)
    for condition in conditions:
        rows = rows.where(condition)
    if values:
        return arranged(rows.select(*columns, *values))
    return arranged(rows.groupBy(*columns).agg(*[model.metrics[m].build().alias(m) for m in measures]))


def _sort_key(
    text: str, columns: Sequence[str], asked: Sequence[str], model: TableModel
) -> Column:
    """A sort order from ``name`` or ``name desc``, a column that was asked for."""
    name, falls = text.strip(), False
    for ending, down in ((" desc", True), (" asc", False)):
        if name.lower().endswith(ending):
            name, falls = name[: -len(ending)], down
    found = model.resolve(name, (columns, asked), "order column")
    return F.col(found).desc_nulls_first() if falls else F.col(found).asc_nulls_last()


def warehousing_cost_october(t: PlanningTables) -> DataFrame:
    """Total warehousing cost by scenario in October."""
    return metric_query(
        t, metrics=["total_warehousing_cost"], dims=["scenario"], filters=["october"]
    )


def margin_impact(t: PlanningTables) -> DataFrame:
    """Margin before and after storage by scenario."""
    return metric_query(
        t,
        "scenario_kpi",
        dims=["scenario_code"],
        facts=["total_gross_margin", "total_warehousing_cost", "net_margin_after_storage"],
    )


def margin_percentages(t: PlanningTables) -> DataFrame:
    """Gross margin and its percentage by scenario."""
    return metric_query(
        t, "scenario_kpi", dims=["scenario"], facts=["total_gross_margin", "gross_margin_pct"]
    )


def revenue_by_family(t: PlanningTables) -> DataFrame:
    """Revenue by product family and scenario."""
    return metric_query(
        t, metrics=["total revenue"], dims=["scenario_code", "family"]
    )


def regional_storage(t: PlanningTables, region: str = "Northeast") -> DataFrame:
    """Warehousing cost of one region by scenario and month."""
    return metric_query(
        t,
        metrics=["total storage cost"],
        dims=["scenario_code", "month"],
        filters=[F.col("region") == region],
    )


def overflow_risk(utilization: DataFrame, scenario: str = "Q4_PUSH") -> DataFrame:
    """Zones a scenario would overfill, from the utilisation projection."""
    return utilization.where(
        (F.col("scenario_code") == scenario) & F.col("is_overflow_risk")
    ).select("zone_name", "site_name", "region", "projected_utilization_pct")


VERIFIED_QUERIES: Mapping[str, Callable[[PlanningTables], DataFrame]] = {
    "warehousing_cost_by_scenario_october": warehousing_cost_october,
    "margin_impact_comparison": margin_impact,
    "revenue_by_product_family_scenario": revenue_by_family,
    "northeast_capacity_impact": regional_storage,
}
