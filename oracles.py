"""Independent SQL for every registered query, written for DuckDB.

``BASE`` rebuilds the planning tables from the benchmark tables as CTEs; a query
names the CTEs it needs and :func:`sql` puts them in front in dependency order.
"""

from __future__ import annotations

import re

MONTHS = "['July','August','September','October','November','December']"

BASE: dict[str, str] = {
    "site": """
        SELECT CAST(n_nationkey AS BIGINT) AS site_id,
               CASE WHEN n_nationkey % 5 = 0 THEN 'PLT-' ELSE 'WH-' END || n_nationkey AS site_code,
               n_name || CASE WHEN n_nationkey % 5 = 0 THEN ' Plant'
                              ELSE ' Distribution Center' END AS site_name,
               CASE WHEN n_nationkey % 5 = 0 THEN 'PLANT' ELSE 'WAREHOUSE' END AS site_type,
               r_name AS region
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "leaf": """
        SELECT DISTINCT p_brand, p_type,
               1000 + CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT) * 10
                    + CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3
                                  WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5
                                  WHEN 'STANDARD' THEN 6 ELSE 0 END AS leaf_id
        FROM part""",
    "product": """
        SELECT p_partkey AS product_id, 'P-' || p_partkey AS product_code, p_name AS product_name,
               leaf_id AS product_category_id, p_brand AS brand,
               p_brand || ' ' || p_type AS product_family,
               CAST(p_retailprice AS DECIMAL(18,4)) AS unit_price,
               CAST(CAST(p_retailprice AS DECIMAL(18,4)) * 0.6 AS DECIMAL(18,4)) AS unit_cost
        FROM part JOIN leaf USING (p_brand, p_type)""",
    "work_center": """
        SELECT s_suppkey AS work_center_id, 'WC-' || s_suppkey AS work_center_code,
               'Line ' || s_suppkey AS work_center_name,
               ['ASSEMBLY','FABRICATION','PACKAGING'][s_suppkey % 3 + 1] AS work_center_type,
               CAST(s_nationkey AS BIGINT) AS site_id,
               CAST(s_suppkey % 3 + 1 AS DECIMAL(18,4)) AS capacity_per_hour,
               CAST(CASE WHEN s_suppkey % 2 = 0 THEN 16 ELSE 24 END AS DECIMAL(8,2)) AS hours_per_day,
               CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 3 END AS available_shifts,
               CASE WHEN s_suppkey % 7 <> 0
                    THEN CAST((80 + s_suppkey % 20) * 0.01 AS DECIMAL(5,4)) END AS efficiency_factor
        FROM supplier""",
    "zone_keys": """
        SELECT site_id, place, site_id * 100 + place AS warehouse_zone_id
        FROM (SELECT CAST(n_nationkey AS BIGINT) AS site_id,
                     unnest(range(1, n_nationkey % 3 + 2)) AS place
              FROM nation WHERE n_nationkey % 5 <> 0)""",
    "zone_size": """
        SELECT *, CASE WHEN warehouse_zone_id % 17 = 3 THEN 0
                       ELSE 500 + warehouse_zone_id * 37 % 1100 END AS max_capacity_pallets
        FROM zone_keys""",
    "zone": """
        SELECT warehouse_zone_id, 'Z-' || warehouse_zone_id AS zone_code,
               'Zone ' || place AS zone_name, site_id,
               ['STANDARD','HIGH_VALUE','COLD_STORAGE'][place] AS zone_type,
               CAST(max_capacity_pallets AS BIGINT) AS max_capacity_pallets,
               CAST(max_capacity_pallets * (50 + warehouse_zone_id % 45) // 100 AS BIGINT)
                 AS current_occupancy_pallets
        FROM zone_size""",
    "cost": """
        SELECT warehouse_zone_id AS logistics_cost_id, site_id, warehouse_zone_id,
               CAST((144 + warehouse_zone_id * 7 % 200) * 0.01 AS DECIMAL(18,4)) AS storage_rate,
               CAST((350 + site_id * 10) * 0.01 AS DECIMAL(18,4)) AS overflow_penalty_rate,
               CAST(CASE WHEN site_id % 2 = 0 THEN 85 ELSE 90 END AS DECIMAL(5,2))
                 AS overflow_penalty_threshold_pct
        FROM zone_keys WHERE warehouse_zone_id % 13 <> 5""",
    "scenario": """
        SELECT * FROM (VALUES
            (CAST(1 AS BIGINT), 'BASELINE', 'Baseline Forecast', 'BASELINE', TRUE,
             CAST(NULL AS BIGINT)),
            (2, 'Q4_PUSH', 'Q4 Marketing Push', 'MARKETING_PUSH', FALSE, NULL),
            (3, 'CONSERVATIVE', 'Conservative Estimate', 'CONSERVATIVE', FALSE, NULL))
          AS fixed(scenario_id, scenario_code, scenario_name, scenario_type,
                   is_official_baseline, parent_scenario_id)
        UNION ALL
        SELECT 100 + r_regionkey, 'CUSTOM_' || r_regionkey, 'Plan for ' || r_name, 'CUSTOM',
               FALSE, 1
        FROM region""",
    "sales": """
        SELECT l_partkey AS product_id, CAST(s_nationkey AS BIGINT) AS site_id,
               (month(l_shipdate) - 1) % 6 + 7 AS m,
               CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(14,2)) AS units
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        GROUP BY ALL""",
    "rules": """
        SELECT * FROM (VALUES
            (0, CAST(1 AS BIGINT), 1.00, 1.00, 0.95, TRUE), (1, 2, 1.00, 1.30, 0.85, TRUE),
            (2, 3, 0.90, 0.90, 0.75, TRUE), (3, 2, 1.10, 1.10, 0.50, FALSE))
          AS r(place, scenario_id, q3, q4, confidence_level, is_current_version)""",
    "versions": f"""
        SELECT ((s.product_id * 32 + site_id) * 16 + m) * 4 + place AS demand_forecast_id,
               s.product_id, site_id, scenario_id, make_date(2024, m, 1) AS forecast_date,
               CAST(units * CAST(CASE WHEN m < 10 THEN q3 ELSE q4 END AS DECIMAL(3,2))
                    AS DECIMAL(18,4)) AS forecast_quantity,
               CAST(confidence_level AS DECIMAL(5,2)) AS confidence_level,
               {MONTHS}[m - 6] AS fiscal_month, m - 6 AS ordinal,
               CASE WHEN m < 10 THEN 'Q3' ELSE 'Q4' END AS fiscal_quarter,
               CAST(p_retailprice AS DECIMAL(18,4)) AS unit_revenue, is_current_version
        FROM sales s JOIN part ON p_partkey = s.product_id CROSS JOIN rules""",
    "forecast": """
        SELECT *, CAST(forecast_quantity * unit_revenue AS DECIMAL(18,2)) AS total_revenue
        FROM versions WHERE is_current_version""",
    "line": """
        SELECT f.*, c.scenario_code, c.scenario_name, c.scenario_type, c.is_official_baseline,
               p.product_code, p.product_name, p.product_family, p.brand, p.unit_cost,
               s.site_code, s.site_name, s.site_type, s.region,
               f.forecast_quantity * p.unit_cost AS total_cost,
               f.total_revenue - f.forecast_quantity * p.unit_cost AS gross_margin
        FROM forecast f JOIN scenario c USING (scenario_id) JOIN product p USING (product_id)
             JOIN site s USING (site_id)""",
    "comparison": """
        SELECT l.*, storage_rate, overflow_penalty_rate, overflow_penalty_threshold_pct,
               round(forecast_quantity * CAST(storage_rate * 3 AS DECIMAL(18,4)), 2)
                 AS projected_warehousing_cost
        FROM line l LEFT JOIN cost USING (site_id)""",
    "site_rate": """
        SELECT site_id, CAST(avg(storage_rate) AS DECIMAL(18,4)) AS storage_rate
        FROM cost GROUP BY site_id""",
    "capacity": """
        SELECT work_center_id, work_center_code, work_center_name, work_center_type, site_id,
               site_code, site_name, region, capacity_per_hour, hours_per_day, available_shifts,
               efficiency_factor,
               round(daily, 2) AS max_daily_capacity, round(daily * 22, 2) AS max_monthly_capacity
        FROM (SELECT *, CAST(capacity_per_hour AS DECIMAL(10,0))
                        * CAST(hours_per_day AS DECIMAL(4,0)) * available_shifts
                        * CAST(coalesce(efficiency_factor, 1) AS DECIMAL(5,4)) AS daily
              FROM work_center)
             JOIN site USING (site_id)""",
    "zone_full": """
        SELECT z.*, s.site_code, s.site_name, s.region, s.site_type, c.storage_rate,
               c.overflow_penalty_rate, c.overflow_penalty_threshold_pct
        FROM zone z JOIN site s USING (site_id)
             LEFT JOIN cost c USING (warehouse_zone_id)""",
}


def half_up(top: str, bottom: str, digits: int = 2) -> str:
    """``top / bottom`` rounded half away from zero in whole-number arithmetic.

    ``top`` may carry up to six decimals, ``bottom`` must be a whole number.
    """
    scaled = f"CAST(round(abs({top}) * 1000000, 0) AS HUGEINT)"
    whole = f"CAST(abs({bottom}) * 1000000 AS HUGEINT)"
    size = f"(({scaled} * {2 * 10**digits} + {whole}) // (2 * {whole}))"
    return (
        f"CASE WHEN {bottom} = 0 THEN NULL ELSE "
        f"CAST(sign({top}) * sign({bottom}) AS DOUBLE) * CAST({size} AS DOUBLE) / {10**digits} END"
    )


def d2(expr: str, name: str) -> str:
    return f"CAST(round({expr}, 2) AS DOUBLE) AS {name}"


def d4(expr: str, name: str) -> str:
    return f"CAST(round({expr}, 4) AS DOUBLE) AS {name}"


def sql(body: str, **extra: str) -> str:
    """The body behind the CTEs it mentions, directly or through another."""
    known = {**BASE, **extra}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in ordered and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(known[name])
                ordered.append(name)

    visit(body)
    parts = [f"{name} AS ({known[name]}\n)" for name in ordered]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


ORACLES: dict[str, str] = {}

COMPARISON = """
    SELECT scenario_id, scenario_code, scenario_name, scenario_type, is_official_baseline,
           product_id, product_code, product_name, {family} AS product_family,
           site_id, site_code, site_name, site_type, region, forecast_date,
           'FY24-' || upper(fiscal_month[1:3]) AS fiscal_period, fiscal_month, fiscal_quarter,
           CAST(2024 AS BIGINT) AS fiscal_year,
           CAST(forecast_quantity AS DOUBLE) AS forecast_quantity,
           CAST(confidence_level AS DOUBLE) AS confidence_level, 'DEMAND' AS forecast_type,
           CAST(unit_revenue AS DOUBLE) AS unit_revenue,
           CAST(total_revenue AS DOUBLE) AS total_revenue,
           CAST(unit_cost AS DOUBLE) AS unit_cost, {total_cost}, {margin},
           {rates}
           TIMESTAMP '2024-09-01' AS version_timestamp, TRUE AS is_current_version
"""
_ZONE_RATES = """CAST(storage_rate AS DOUBLE) AS storage_cost_per_pallet_per_day,
           CAST(overflow_penalty_rate AS DOUBLE) AS overflow_penalty_rate,
           CAST(overflow_penalty_threshold_pct AS DOUBLE) AS overflow_penalty_threshold_pct,
           CAST(projected_warehousing_cost AS DOUBLE) AS projected_warehousing_cost,"""
_AVG_RATES = """CAST(storage_rate AS DOUBLE) AS storage_cost_per_pallet_per_day,
           CAST(overflow_penalty_rate AS DOUBLE) AS overflow_penalty_rate,
           CAST(overflow_penalty_threshold_pct AS DOUBLE) AS overflow_penalty_threshold_pct,
           CAST(round(forecast_quantity * CAST(storage_rate * 3 AS DECIMAL(18,4)), 2) AS DOUBLE)
             AS projected_warehousing_cost,"""

ORACLES["scenario_comparison"] = sql(
    COMPARISON.format(
        family="product_family",
        total_cost=d4("total_cost", "total_cost"),
        margin=d4("gross_margin", "gross_margin"),
        rates=_ZONE_RATES,
    )
    + "FROM comparison"
)
ORACLES["scenario_comparison_site_avg"] = sql(
    COMPARISON.format(
        family="brand",
        total_cost=d4("total_cost", "total_cost"),
        margin=d4("gross_margin", "gross_margin"),
        rates=_AVG_RATES,
    )
    + "FROM line LEFT JOIN site_avg USING (site_id)",
    site_avg="""
        SELECT site_id, CAST({} AS DECIMAL(18,4)) AS storage_rate,
               max(overflow_penalty_rate) AS overflow_penalty_rate,
               max(overflow_penalty_threshold_pct) AS overflow_penalty_threshold_pct
        FROM cost GROUP BY site_id""".format(half_up("sum(storage_rate)", "count(*)", 4)),
)

KPIS = """
    SELECT scenario_id, scenario_code, scenario_name, scenario_type, is_official_baseline,
           count(DISTINCT product_id) AS product_count, count(DISTINCT site_id) AS site_count,
           sum(forecast_quantity) AS quantity, sum(total_revenue) AS revenue,
           sum(total_cost) AS cost,
           sum(round(forecast_quantity
                     * CAST(coalesce(storage_rate, 0.5) * 3 AS DECIMAL(18,4)), 2)) AS storage
    FROM line LEFT JOIN {rates} USING (site_id)
    GROUP BY ALL"""
KPI_COLUMNS = f"""
    SELECT scenario_id, scenario_code, scenario_name, scenario_type, is_official_baseline,
           product_count, site_count, {d4("quantity", "total_forecast_quantity")},
           {d2("revenue", "total_forecasted_revenue")}, {d4("cost", "total_forecasted_cost")},
           {d4("revenue - cost", "total_gross_margin")},
           {half_up("((revenue - cost) * 100)", "revenue")} AS gross_margin_pct,
           {d2("storage", "total_warehousing_cost")},
           {d4("revenue - cost - storage", "net_margin_after_storage")},
           TIMESTAMP '2024-09-01' AS _refreshed_timestamp
    FROM kpis"""
ORACLES["scenario_kpis"] = sql(KPI_COLUMNS, kpis=KPIS.format(rates="cost"))
ORACLES["scenario_kpis_site_avg"] = sql(
    KPI_COLUMNS,
    kpis=KPIS.format(rates="site_avg"),
    site_avg="SELECT site_id, CAST({} AS DECIMAL(18,4)) AS storage_rate FROM cost "
    "GROUP BY site_id".format(half_up("sum(storage_rate)", "count(*)", 4)),
)

ORACLES["production_capacity"] = sql(
    """
    SELECT work_center_id, work_center_code, work_center_name, work_center_type, site_id,
           site_code, site_name, region, CAST(capacity_per_hour AS DOUBLE) AS capacity_per_hour,
           CAST(hours_per_day AS DOUBLE) AS hours_per_day,
           CAST(available_shifts AS BIGINT) AS available_shifts,
           CAST(efficiency_factor AS DOUBLE) AS efficiency_factor,
           CAST(max_daily_capacity AS DOUBLE) AS max_daily_capacity,
           CAST(max_monthly_capacity AS DOUBLE) AS max_monthly_capacity
    FROM capacity"""
)

UTILISATION = f"""
    SELECT warehouse_zone_id, zone_code, zone_name, zone_type, site_id, site_code, site_name,
           region, max_capacity_pallets, current_occupancy_pallets, scenario_id, scenario_code,
           scenario_name, fiscal_month, fiscal_quarter, CAST(u AS DOUBLE) AS projected_units,
           CAST(round(u * 0.1, 4) AS DOUBLE) AS projected_pallets,
           {half_up("(filled * 100)", "cap")} AS projected_utilization_pct,
           coalesce(filled > cap, FALSE) AS is_overflow_risk,
           CAST(overflow_penalty_rate AS DOUBLE) AS overflow_penalty_rate,
           CAST(overflow_penalty_threshold_pct AS DOUBLE) AS overflow_penalty_threshold_pct,
           CASE WHEN cap <> 0 AND filled * 100 > cap * overflow_penalty_threshold_pct
                THEN CAST(round((filled * 100 - cap * overflow_penalty_threshold_pct)
                     * CAST(overflow_penalty_rate * 30 AS DECIMAL(10,4)) * 0.001, 2) AS DOUBLE)
                ELSE 0.0::DOUBLE END AS projected_overflow_penalty
    FROM projected"""
PROJECTED = """
    SELECT z.*, c.scenario_id, c.scenario_code, c.scenario_name, d.fiscal_month, d.fiscal_quarter,
           {units} AS u, max_capacity_pallets * 10 AS cap,
           current_occupancy_pallets * 10 + {units} AS filled
    FROM zone_full z CROSS JOIN scenario c
         LEFT JOIN (SELECT site_id, scenario_id, fiscal_month, fiscal_quarter,
                           CAST(sum(forecast_quantity) AS DECIMAL(22,4)) AS demand
                    FROM forecast GROUP BY ALL) d
           ON d.site_id = z.site_id AND d.scenario_id = c.scenario_id"""
ORACLES["warehouse_utilization"] = sql(UTILISATION, projected=PROJECTED.format(units="demand"))
ORACLES["warehouse_utilization_shared"] = sql(
    UTILISATION,
    projected=PROJECTED.format(
        units="""CAST({} AS DECIMAL(22,4))""".format(
            half_up(
                "(demand * max_capacity_pallets)",
                "(SELECT sum(y.max_capacity_pallets) FROM zone y WHERE y.site_id = z.site_id)",
                4,
            )
        )
    ),
)

BUILDUP = """
    SELECT scenario_id, scenario_code, scenario_name, fiscal_month, fiscal_quarter,
           CAST(demand AS DOUBLE) AS period_demand, CAST(revenue AS DOUBLE) AS period_revenue,
           CAST(prior AS DOUBLE) AS prior_production, CAST(total AS DOUBLE) AS cumulative_demand,
           CAST(total - prior AS DOUBLE) AS inventory_position,
           CAST((total - prior) * 0.5 AS DOUBLE) AS cost_of_carry
    FROM (SELECT *, lag(demand, 1, 0) OVER w AS prior,
                 sum(demand) OVER (w ROWS UNBOUNDED PRECEDING) AS total
          FROM (SELECT scenario_id, scenario_code, scenario_name, fiscal_month, fiscal_quarter,
                       ordinal, CAST(sum(forecast_quantity) AS DECIMAL(22,4)) AS demand,
                       sum(total_revenue) AS revenue
                FROM forecast JOIN scenario USING (scenario_id) GROUP BY ALL)
          WINDOW w AS (PARTITION BY scenario_id ORDER BY {step}))"""
ORACLES["inventory_buildup"] = sql(BUILDUP.format(step="fiscal_month"))
ORACLES["inventory_buildup_fiscal"] = sql(BUILDUP.format(step="ordinal"))

# Executive dashboard ---------------------------------------------------------

ORACLES["planning_stats"] = sql(
    f"""
    SELECT count(DISTINCT scenario_code) AS scenarios, count(DISTINCT product_id) AS products,
           count(DISTINCT site_id) AS sites, {d4("sum(forecast_quantity)", "total_forecast")}
    FROM comparison"""
)
SUMMARY = f"""
    SELECT scenario_code, scenario_name, fiscal_quarter,
           {d4("sum(forecast_quantity)", "total_demand")},
           {d2("sum(total_revenue)", "total_revenue")},
           count(DISTINCT product_id) AS product_count, count(DISTINCT site_id) AS site_count
    FROM {{rows}} GROUP BY ALL"""
ORACLES["scenario_summary"] = sql(SUMMARY.format(rows="comparison"))
ORACLES["scenario_summary_site_avg"] = sql(SUMMARY.format(rows="line"))

SITE_COST = """
    SELECT scenario_code, scenario_name, site_name, demand, storage_cost, capacity_threshold,
           overflow_rate,
           CASE WHEN CAST(demand AS DOUBLE) - 10000.0 * capacity_threshold / 100 > 0
                THEN round((CAST(demand AS DOUBLE) - 10000.0 * capacity_threshold / 100)
                           / 10 * overflow_rate * 30, 2)
                ELSE CAST(0 AS DOUBLE) END AS overflow_cost
    FROM (SELECT scenario_code, scenario_name, site_name, sum(forecast_quantity) AS demand,
                 sum(projected_warehousing_cost) AS storage_cost,
                 CAST(sum(overflow_penalty_threshold_pct) AS DOUBLE)
                   / count(overflow_penalty_threshold_pct) AS capacity_threshold,
                 CAST(sum(overflow_penalty_rate) AS DOUBLE)
                   / count(overflow_penalty_rate) AS overflow_rate
          FROM comparison WHERE fiscal_quarter IN ('Q3', 'Q4') GROUP BY ALL)"""
# The same under the default capacity of a site, a million units.
AT_DEFAULT = SITE_COST.replace("10000.0", "1000000.0")
WAREHOUSE_COST = f"""
    SELECT scenario_code, scenario_name, site_name, {d4("demand", "demand")},
           {d2("storage_cost", "storage_cost")}, capacity_threshold, overflow_rate, overflow_cost
    FROM site_cost"""
ORACLES["warehouse_cost"] = sql(WAREHOUSE_COST, site_cost=SITE_COST)
ORACLES["warehouse_cost_default"] = sql(WAREHOUSE_COST, site_cost=AT_DEFAULT)
DEMAND_BY_MONTH = f"""
    SELECT scenario_code, fiscal_month, fiscal_quarter,
           {d4("sum(forecast_quantity)", "total_demand")},
           {d2("sum(total_revenue)", "total_revenue")}, ordinal AS month_order
    FROM comparison GROUP BY scenario_code, fiscal_month, fiscal_quarter, ordinal"""
ORACLES["monthly_demand"] = sql(DEMAND_BY_MONTH)
ORACLES["monthly_demand_report"] = sql(DEMAND_BY_MONTH + "\n    ORDER BY scenario_code, ordinal")
ORACLES["demand_preview_rows"] = sql(
    DEMAND_BY_MONTH + "\n    ORDER BY scenario_code, fiscal_month LIMIT 10"
)
ORACLES["available_scenarios"] = sql(
    """
    SELECT DISTINCT scenario_id, scenario_code, scenario_name, is_official_baseline
    FROM scenario WHERE scenario_code IN (SELECT scenario_code FROM line)"""
)
HEADLINE = """
    SELECT base_demand, other_demand,
           round((other_demand - base_demand) / base_demand * 100, 2) AS demand_delta_pct,
           base_cost, other_cost, other_overflow,
           round((other_cost - base_cost) / base_cost * 100, 2) AS cost_delta_pct,
           round((other_cost - base_cost) / base_cost * 100, 2) > 15 AS cost_alert
    FROM (SELECT
             CAST(sum(demand) FILTER (scenario_code = 'BASELINE') AS DOUBLE) AS base_demand,
             CAST(sum(demand) FILTER (scenario_code = 'Q4_PUSH') AS DOUBLE) AS other_demand,
             round(CAST(sum(storage_cost) FILTER (scenario_code = 'BASELINE') AS DOUBLE)
                   + round(sum(overflow_cost) FILTER (scenario_code = 'BASELINE'), 2), 2)
               AS base_cost,
             round(CAST(sum(storage_cost) FILTER (scenario_code = 'Q4_PUSH') AS DOUBLE)
                   + round(sum(overflow_cost) FILTER (scenario_code = 'Q4_PUSH'), 2), 2)
               AS other_cost,
             round(sum(overflow_cost) FILTER (scenario_code = 'Q4_PUSH'), 2) AS other_overflow
          FROM site_cost)"""
ORACLES["headline_kpis"] = sql(HEADLINE, site_cost=SITE_COST)
ORACLES["headline_kpis_default"] = sql(HEADLINE, site_cost=AT_DEFAULT)
_CELLS = ",\n           ".join(
    f"round(coalesce(sum({value}) FILTER (scenario_code = '{code}'), 0), 0)"
    f" AS {code.lower()}_{name}"
    for code in ("BASELINE", "Q4_PUSH", "CONSERVATIVE")
    for name, value in (
        ("storage_cost", "CAST(storage_cost AS DOUBLE)"),
        ("overflow_cost", "overflow_cost"),
        ("total_warehouse_cost", "CAST(storage_cost AS DOUBLE) + overflow_cost"),
    )
)
ORACLES["cost_matrix"] = sql(
    f"""
    SELECT site_name, {_CELLS},
           round(sum(CAST(storage_cost AS DOUBLE) + overflow_cost), 0) AS all_scenarios
    FROM site_cost GROUP BY site_name""",
    site_cost=SITE_COST,
)
MATRIX = """
    SELECT fiscal_month, ordinal AS month_order,
           CAST(sum(forecast_quantity) FILTER (scenario_code = 'BASELINE') AS DOUBLE)
             AS "BASELINE",
           CAST(sum(forecast_quantity) FILTER (scenario_code = 'Q4_PUSH') AS DOUBLE) AS "Q4_PUSH",
           CAST(sum(forecast_quantity) FILTER (scenario_code = 'CONSERVATIVE') AS DOUBLE)
             AS "CONSERVATIVE"
    FROM comparison GROUP BY fiscal_month, ordinal"""
ORACLES["demand_matrix"] = sql(MATRIX)
ORACLES["demand_increase"] = sql(
    """
    SELECT fiscal_month, month_order, round(increase, 4) AS increase_pct,
           CASE WHEN month_order > 3
                THEN round(avg(increase) FILTER (month_order > 3) OVER (), 4) END
             AS q4_mean_increase_pct
    FROM (SELECT *, ("Q4_PUSH" - "BASELINE") / "BASELINE" * 100 AS increase FROM matrix)""",
    matrix=MATRIX,
)
ORACLES["bottleneck_site"] = sql(
    """
    SELECT site_name, overflow_cost FROM site_cost WHERE scenario_code = 'Q4_PUSH'
    ORDER BY overflow_cost DESC, site_name LIMIT 1""",
    site_cost=SITE_COST,
)
ORACLES["cost_verdict"] = sql(
    f"""
    SELECT {d2("b.storage", "base_cost")}, {d2("o.storage", "other_cost")},
           CASE WHEN o.storage > b.storage THEN 'HIGHER' ELSE 'LOWER' END AS verdict
    FROM kpis b, (SELECT * FROM kpis) o
    WHERE b.scenario_code = 'BASELINE' AND o.scenario_code = 'Q4_PUSH'""",
    kpis=KPIS.format(rates="cost"),
)

# Capacity --------------------------------------------------------------------

ORACLES["capacity_by_line"] = sql(
    """
    SELECT site_name, work_center_name, CAST(max_daily_capacity AS DOUBLE) AS max_daily_capacity,
           CAST(max_monthly_capacity AS DOUBLE) AS max_monthly_capacity,
           CAST(hours_per_day AS DOUBLE) AS hours_per_day,
           CAST(efficiency_factor AS DOUBLE) AS efficiency_factor
    FROM capacity"""
)
STATUS = f"""
    SELECT site_name, zone_name, max_capacity_pallets, current_occupancy_pallets, zone_type,
           CAST(storage_rate AS DOUBLE) AS storage_cost,
           CAST(overflow_penalty_threshold_pct AS DOUBLE) AS capacity_threshold_percent,
           CAST(overflow_penalty_rate AS DOUBLE) AS overflow_cost_factor,
           {half_up("(current_occupancy_pallets * 100)", "max_capacity_pallets", 1)}
             AS utilization_pct
    FROM zone_full"""
BANDED = """
    SELECT *, CASE WHEN utilization_pct >= 90 THEN 'danger' WHEN utilization_pct >= 80
                   THEN 'warning' ELSE 'ok' END AS band
    FROM status"""
ORACLES["zone_status"] = sql(BANDED, status=STATUS)
ORACLES["zones_at_risk"] = sql(BANDED + " WHERE utilization_pct >= 80", status=STATUS)
ORACLES["site_capacity"] = sql(
    """
    SELECT site_name, CAST(sum(max_monthly_capacity) AS DOUBLE) AS max_monthly_capacity,
           CAST(sum(max_daily_capacity) AS DOUBLE) AS max_daily_capacity
    FROM capacity GROUP BY site_name"""
)
ORACLES["total_capacity"] = sql(
    """
    SELECT CAST(sum(max_daily_capacity) AS DOUBLE) AS daily_capacity,
           CAST(sum(max_monthly_capacity) AS DOUBLE) AS monthly_capacity
    FROM capacity"""
)
ORACLES["warehouse_totals"] = sql(
    """
    SELECT CAST(sum(max_capacity_pallets) AS BIGINT) AS total_capacity_pallets,
           CAST(sum(current_occupancy_pallets) AS BIGINT) AS current_occupancy_pallets
    FROM zone_full WHERE site_type = 'WAREHOUSE'"""
)
ORACLES["capacity_overview"] = sql(
    f"""
    SELECT (SELECT CAST(sum(max_monthly_capacity) AS DOUBLE) FROM capacity)
             AS monthly_production_capacity,
           CAST(sum(max_capacity_pallets) AS BIGINT) AS total_capacity_pallets,
           CAST(sum(current_occupancy_pallets) AS BIGINT) AS occupied_pallets,
           {half_up("(sum(current_occupancy_pallets) * 100)", "sum(max_capacity_pallets)", 1)}
             AS utilization_pct,
           count(DISTINCT CASE WHEN utilization_pct > 80 THEN site_name END) AS sites_at_risk
    FROM status""",
    status=STATUS,
)
VERSUS = f"""
    SELECT fiscal_month, fiscal_quarter, scenario_code, ordinal AS month_order,
           CAST(demand AS DOUBLE) AS total_demand, CAST(cap AS DOUBLE) AS total_capacity,
           CAST(cap - demand AS DOUBLE) AS gap,
           {half_up("((cap - demand) * 1000000)", "CAST(cap * 10000 AS BIGINT)")} AS gap_pct
    FROM (SELECT fiscal_month, fiscal_quarter, scenario_code, ordinal,
                 CAST(sum(forecast_quantity) AS DECIMAL(20,4)) AS demand,
                 (SELECT CAST(sum(max_monthly_capacity) AS DECIMAL(20,4)) FROM capacity) AS cap
          FROM comparison GROUP BY ALL)"""
ORACLES["demand_vs_capacity"] = sql(VERSUS)
ORACLES["capacity_shortfalls"] = sql(
    VERSUS + "\n    WHERE scenario_code = 'Q4_PUSH' AND cap < demand"
)

# Scenario builder ------------------------------------------------------------

ORACLES["builder_scenarios"] = sql(
    """
    SELECT scenario_id, scenario_code, scenario_name,
           'About ' || scenario_name AS scenario_description, is_official_baseline
    FROM scenario ORDER BY is_official_baseline DESC, scenario_name"""
)
ORACLES["builder_products"] = sql(
    """
    SELECT DISTINCT product_id, product_name, product_family AS category_name FROM product"""
)
ORACLES["builder_sites"] = sql("SELECT DISTINCT site_id, site_name, site_code FROM site")
ORACLES["forecast_detail"] = sql(
    """
    SELECT demand_forecast_id, product_id, product_name, site_id, site_name, forecast_date,
           CAST(forecast_quantity AS DOUBLE) AS forecast_quantity, scenario_id, scenario_code
    FROM line"""
)
ORACLES["scenario_detail"] = sql(
    """
    SELECT product_name, site_name, fiscal_month, fiscal_quarter,
           CAST(forecast_quantity AS DOUBLE) AS forecast_quantity,
           CAST(total_revenue AS DOUBLE) AS total_revenue
    FROM comparison WHERE scenario_id = 2"""
)
ORACLES["scenario_month_totals"] = sql(
    f"""
    SELECT fiscal_month, fiscal_quarter, {d4("sum(forecast_quantity)", "forecast_quantity")},
           {d2("sum(total_revenue)", "total_revenue")}, ordinal AS month_order
    FROM comparison WHERE scenario_id = 2 GROUP BY fiscal_month, fiscal_quarter, ordinal"""
)
PREVIEW = """
    SELECT fiscal_quarter, CAST(count(*) AS BIGINT) AS affected_rows,
           CAST(sum(forecast_quantity) AS DOUBLE) AS current_total,
           CAST({projected} AS DOUBLE) AS projected_total
    FROM {rows} WHERE scenario_id = 2 {filter} GROUP BY fiscal_quarter"""
ORACLES["preview_percent"] = sql(
    PREVIEW.format(
        projected="round(sum(forecast_quantity) * 1.15, 4)", rows="comparison", filter=""
    )
)
ORACLES["preview_units"] = sql(
    PREVIEW.format(
        projected="sum(forecast_quantity) + 100",
        rows="comparison",
        filter="AND fiscal_quarter = 'Q4'",
    )
)
ORACLES["preview_units_per_row"] = sql(
    PREVIEW.format(projected="sum(forecast_quantity + 100)", rows="line", filter="")
)
ORACLES["preview_totals"] = sql(
    """
    SELECT current_total, projected_total,
           round((projected_total - current_total) / current_total * 100, 2) AS change_pct
    FROM (SELECT CAST(sum(forecast_quantity) AS DOUBLE) AS current_total,
                 CAST(round(sum(forecast_quantity) * 1.15, 4) AS DOUBLE) AS projected_total
          FROM comparison WHERE scenario_id = 2)"""
)

# Write-back ------------------------------------------------------------------

VERSIONS = f"""
    SELECT demand_forecast_id, scenario_id, product_id, site_id, is_current_version,
           forecast_method, forecast_type, updated_by_user, fiscal_month,
           {d4("forecast_quantity", "forecast_quantity")}, {d2("total_revenue", "total_revenue")}
    FROM changed"""
STORED = """
    SELECT demand_forecast_id, product_id, site_id, scenario_id, forecast_quantity,
           CAST(forecast_quantity * unit_revenue AS DECIMAL(18,2)) AS total_revenue,
           unit_revenue, forecast_date, fiscal_month, fiscal_quarter, is_current_version,
           'HISTORY' AS forecast_method, 'DEMAND' AS forecast_type,
           CAST(NULL AS VARCHAR) AS updated_by_user
    FROM versions"""
SUBMITTED = """
    SELECT demand_forecast_id, scenario_id, product_id, site_id, forecast_quantity,
           total_revenue, fiscal_month, is_current_version AND scenario_id <> {target} AS is_current_version,
           forecast_method, forecast_type,
           CASE WHEN scenario_id = {target} AND is_current_version THEN 'planner' END
             AS updated_by_user
    FROM stored
    UNION ALL {fresh}"""
RESUBMITTED = """
    SELECT (SELECT max(demand_forecast_id) FROM stored)
             + row_number() OVER (ORDER BY product_id, site_id, forecast_date),
           2, product_id, site_id, q, CAST({counted} * unit_revenue AS DECIMAL(18,2)), fiscal_month, TRUE,
           'MANUAL_ADJUSTMENT', 'DEMAND', NULL
    FROM (SELECT *, CAST(forecast_quantity * 1.07 AS DECIMAL(18,4)) AS q FROM stored
          WHERE scenario_id = 2 AND is_current_version)"""
ORACLES["submit_version"] = sql(
    VERSIONS,
    stored=STORED,
    changed=SUBMITTED.format(
        target=2, fresh=RESUBMITTED.format(counted="CAST(q AS DECIMAL(18,0))")
    ),
)
ORACLES["submit_version_declared"] = sql(
    VERSIONS,
    stored=STORED,
    changed=SUBMITTED.format(target=2, fresh=RESUBMITTED.format(counted="q")),
)
ORACLES["submit_version_receipt"] = sql(
    """
    SELECT 'SUCCESS' AS status, count(*) AS rows_superseded, count(*) AS rows_inserted,
           CAST(2 AS BIGINT) AS scenario_id, TIMESTAMP '2024-09-01' AS version_timestamp,
           'planner' AS submitted_by
    FROM forecast WHERE scenario_id = 2"""
)
ORACLES["submit_json_payload"] = sql(
    VERSIONS + " WHERE scenario_id = 3",
    stored=STORED,
    changed=SUBMITTED.format(
        target=3,
        fresh="""
    SELECT (SELECT max(demand_forecast_id) FROM stored) + row_number() OVER (
             ORDER BY p NULLS FIRST, s NULLS FIRST, d NULLS FIRST, q NULLS FIRST, kind),
           3, p, s, CAST(q + 0.5 AS DECIMAL(18,4)),
           CAST(CAST(q + 1 AS DECIMAL(18,0)) * 2.25 AS DECIMAL(18,2)),
           monthname(d), TRUE, 'MANUAL_ADJUSTMENT', kind, NULL
    FROM (SELECT l_partkey AS p, l_suppkey % 25 AS s, CAST(l_shipdate AS DATE) AS d,
                 l_quantity AS q, CASE WHEN l_linenumber = 1 THEN 'SUPPLY' ELSE 'DEMAND' END AS kind
          FROM lineitem
          UNION ALL
          SELECT l_partkey, l_suppkey % 25, CAST(l_shipdate AS DATE), l_quantity + 1, 'SUPPLY'
          FROM lineitem WHERE l_linenumber = 1
          UNION ALL
          SELECT NULL, NULL, NULL, NULL, 'DEMAND' FROM lineitem WHERE l_linenumber = 2)""",
    ),
)
ORACLES["dense_key_allocation"] = """
    SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey,
           CAST((SELECT max(o_orderkey) FROM orders) + row_number() OVER (
             ORDER BY l_partkey, l_orderkey, l_linenumber, l_suppkey) AS BIGINT) AS "key"
    FROM lineitem"""
COPIED = """
    SELECT demand_forecast_id, scenario_id, product_id, site_id, forecast_quantity,
           total_revenue, fiscal_month, is_current_version, forecast_method, forecast_type, updated_by_user
    FROM stored
    UNION ALL
    SELECT (SELECT max(demand_forecast_id) FROM stored)
             + row_number() OVER (ORDER BY demand_forecast_id),
           (SELECT max(scenario_id) + 1 FROM scenario), product_id, site_id, forecast_quantity,
           {columns}
    FROM stored WHERE scenario_id = 2 AND is_current_version"""
ORACLES["copy_scenario"] = sql(
    VERSIONS,
    stored=STORED,
    changed=COPIED.format(
        columns="total_revenue, fiscal_month, TRUE, forecast_method, forecast_type, NULL"
    ),
)
ORACLES["copy_scenario_minimal"] = sql(
    VERSIONS,
    stored=STORED,
    changed=COPIED.format(columns="NULL, NULL, TRUE, NULL, 'Copied', NULL"),
)
ORACLES["copy_scenario_definitions"] = sql(
    """
    SELECT scenario_id, scenario_code, scenario_name,
           'About ' || scenario_name AS scenario_description, scenario_type,
           is_official_baseline, CAST(1 AS BIGINT) AS version_number, parent_scenario_id
    FROM scenario
    UNION ALL
    SELECT (SELECT max(scenario_id) + 1 FROM scenario), 'RESIN_GAP', 'Resin gap in autumn',
           'Copy of ' || scenario_name, 'CUSTOM', FALSE, 1, 2
    FROM scenario WHERE scenario_id = 2"""
)
ORACLES["copy_scenario_receipt"] = sql(
    """
    SELECT '{"status":"SUCCESS","new_scenario_id":'
           || (SELECT max(scenario_id) + 1 FROM scenario)
           || ',"new_scenario_code":"RESIN_GAP","source_scenario_id":2,"forecasts_copied":'
           || count(*) || ',"created_by":"planner"}' AS receipt
    FROM forecast WHERE scenario_id = 2"""
)
ADJUSTED = """
    SELECT demand_forecast_id, scenario_id, product_id, site_id,
           CASE WHEN hit THEN CAST({moved} AS DECIMAL(18,4)) ELSE forecast_quantity END
             AS forecast_quantity,
           {revenue} AS total_revenue, fiscal_month, is_current_version, forecast_method,
           forecast_type, CASE WHEN hit THEN 'planner' END AS updated_by_user
    FROM (SELECT *, scenario_id = 2 AND is_current_version AND {hit} AS hit FROM stored)"""
ORACLES["adjust_percent"] = sql(
    VERSIONS,
    stored=STORED,
    changed=ADJUSTED.format(
        moved="forecast_quantity * 1.15",
        revenue="total_revenue",
        hit="month(forecast_date) IN (10, 11, 12)",
    ),
)
ORACLES["adjust_units"] = sql(
    VERSIONS,
    stored=STORED,
    changed=ADJUSTED.format(
        moved="forecast_quantity + 100",
        revenue="CASE WHEN hit THEN CAST((forecast_quantity + 100) * unit_revenue "
        "AS DECIMAL(18,2)) ELSE total_revenue END",
        hit="TRUE",
    ),
)
ORACLES["adjust_filtered"] = sql(
    VERSIONS,
    stored=STORED,
    changed=ADJUSTED.format(
        moved="forecast_quantity * 0.90",
        revenue="total_revenue",
        hit="site_id = 6 AND product_id IN (SELECT product_id FROM product "
        "WHERE product_family = 'Brand#7 PROMO')",
    ),
)
ORACLES["upsert_products"] = sql(
    """
    SELECT product_id, CAST(unit_price AS DOUBLE) AS unit_price, is_current_flag,
           updated_by_user, created_by_user, valid_to IS NOT NULL AS closed
    FROM (
        SELECT product_id, unit_price, FALSE AS is_current_flag, 1 AS valid_to,
               CAST(NULL AS VARCHAR) AS updated_by_user, 'system' AS created_by_user
        FROM product WHERE product_id % 10 = 0
        UNION ALL
        SELECT product_id, unit_price, TRUE, NULL, NULL, 'system' FROM product
        WHERE product_id % 3 <> 0 OR product_id % 30 = 0
        UNION ALL
        SELECT product_id, unit_price, FALSE, 1, 'planner', 'system' FROM product
        WHERE product_id % 3 = 0 AND product_id % 30 <> 0
        UNION ALL
        SELECT CASE WHEN product_id % 30 = 0 THEN product_id + 10000000 ELSE product_id END,
               unit_price + 5, TRUE, NULL, NULL, 'planner' FROM product
        WHERE product_id % 3 = 0)"""
)

# Build plan ------------------------------------------------------------------
# The oracle solves each plan by a backward and a forward recursion over the six
# months, written out, instead of running sums and maxima.

_DEMANDS = ",\n           ".join(
    f"CAST(floor(coalesce(sum(q) FILTER (ordinal = {m}), 0)) AS BIGINT) AS d{m}"
    for m in range(1, 7)
)
_SAFETY = ", ".join(
    f"CAST(floor(d{m + 1} * 0.15) AS BIGINT) AS s{m}" if m < 6 else "0 AS s6" for m in range(1, 7)
)


def plan_oracle(keys: str, rows: str, limits: str, extra_from: str = "") -> dict[str, str]:
    """CTEs from monthly demand to the solved plan."""
    ctes = {
        "monthly": f"SELECT {keys}, {_DEMANDS} FROM {rows} GROUP BY {keys}",
        "limited": f"SELECT m.*, {limits} FROM monthly m {extra_from}",
        "safe": f"SELECT *, {_SAFETY}, 0 AS r6 FROM limited",
    }
    previous = "safe"
    for m in range(5, 0, -1):
        ctes[f"back{m}"] = (
            f"SELECT *, greatest(s{m}, r{m + 1} + d{m + 1} - capacity) AS r{m} FROM {previous}"
        )
        previous = f"back{m}"
    for m in range(1, 7):
        before = "initial_inventory" if m == 1 else f"i{m - 1}"
        ctes[f"forth{m}"] = (
            f"SELECT *, greatest(r{m}, {before} - d{m}) AS i{m},"
            f" greatest(r{m}, {before} - d{m}) - {before} + d{m} AS p{m} FROM {previous}"
        )
        previous = f"forth{m}"
    fits = " AND ".join(
        f"p{m} BETWEEN 0 AND capacity AND i{m} >= s{m} AND i{m} BETWEEN 0 AND max_inventory"
        for m in range(1, 7)
    )
    ctes["solved"] = f"SELECT *, {fits} AS ok FROM {previous}"
    cells = ", ".join(
        f"{{'period': {m}, 'demand': d{m}, 'safety': s{m}, 'made': p{m}, 'held': i{m}}}"
        for m in range(1, 7)
    )
    ctes["cells"] = (
        f"SELECT {keys}, capacity, max_inventory, initial_inventory, ok,"
        f" unnest([{cells}]) AS c FROM solved"
    )
    ctes["plan"] = f"""
        SELECT {keys}, c.period AS period, c.demand AS demand, capacity, max_inventory,
               initial_inventory, CAST(c.safety AS BIGINT) AS safety_stock,
               CASE WHEN ok THEN 'Optimal' ELSE 'Infeasible' END AS status,
               CASE WHEN ok THEN c.made END AS production,
               CASE WHEN ok THEN c.held END AS ending_inventory,
               CASE WHEN ok THEN CAST(c.made AS DOUBLE) END AS production_cost,
               CASE WHEN ok THEN CAST(c.held * 0.22 AS DOUBLE) END AS storage_cost
        FROM cells"""
    return ctes


PUSHED = "(SELECT *, forecast_quantity AS q FROM {rows} WHERE scenario_id IN (1, 2))"
LIMITS = """
    SELECT (SELECT CAST(floor(sum(max_monthly_capacity)) AS BIGINT) FROM capacity) AS capacity,
           CAST(floor(sum(max_capacity_pallets) * 10 * 0.87) AS BIGINT) AS max_inventory,
           CAST(sum(current_occupancy_pallets) * 10 AS BIGINT) AS initial_inventory
    FROM zone_full WHERE site_type = 'WAREHOUSE'"""
ORACLES["plan_limits"] = sql(LIMITS)
ORACLES["network_plan"] = sql(
    "SELECT * FROM plan",
    net=LIMITS,
    **plan_oracle(
        "scenario_id, scenario_code",
        PUSHED.format(rows="comparison"),
        "capacity, max_inventory, initial_inventory",
        "CROSS JOIN net",
    ),
)
ORACLES["site_plans"] = sql(
    "SELECT * FROM plan",
    made="SELECT site_id, CAST(floor(sum(max_monthly_capacity)) AS BIGINT) AS capacity "
    "FROM capacity GROUP BY site_id",
    stock="""SELECT site_id,
                    CAST(floor(sum(max_capacity_pallets) * 10 * 0.87) AS BIGINT) AS most,
                    CAST(sum(current_occupancy_pallets) * 10 AS BIGINT) AS held
             FROM zone GROUP BY site_id""",
    **plan_oracle(
        "scenario_id, scenario_code, site_id",
        PUSHED.format(rows="comparison"),
        "coalesce(capacity, 0) AS capacity, coalesce(most, 0) AS max_inventory, "
        "coalesce(held, 0) AS initial_inventory",
        "LEFT JOIN made USING (site_id) LEFT JOIN stock USING (site_id)",
    ),
)
_SUM6 = "(" + " + ".join(f"d{m}" for m in range(1, 7)) + ")"
PRODUCT_PLAN = plan_oracle(
    "scenario_id, scenario_code, product_id",
    PUSHED.format(rows="line"),
    f"{_SUM6} * 11 // 60 AS capacity, {_SUM6} * 2 // 6 AS max_inventory, "
    f"{_SUM6} // 12 AS initial_inventory",
)
ORACLES["product_plans"] = sql("SELECT * FROM plan", **PRODUCT_PLAN)
SCHEDULE = f"""
    SELECT scenario_id, scenario_code, product_id, period, {MONTHS}[period] AS fiscal_month,
           CASE WHEN period <= 3 THEN 'Q3' ELSE 'Q4' END AS fiscal_quarter, demand,
           production AS recommended_production, ending_inventory, capacity,
           coalesce({half_up("(production * 100)", "capacity", 1)}, 0)
             AS capacity_utilization_pct,
           coalesce({half_up("(ending_inventory * 100)", "max_inventory", 1)}, 0)
             AS warehouse_utilization_pct,
           production_cost, storage_cost,
           CAST(sum(CAST(production AS DECIMAL(18,2)) + CAST(ending_inventory * 0.22
                    AS DECIMAL(18,2))) OVER (PARTITION BY scenario_id, product_id
                                             ORDER BY period) AS DOUBLE) AS cumulative_cost
    FROM plan WHERE status = 'Optimal'"""
ORACLES["plan_schedule"] = sql("SELECT * FROM schedule", **PRODUCT_PLAN, schedule=SCHEDULE)
ORACLES["plan_summary"] = sql(
    """
    SELECT scenario_id, scenario_code, product_id, max(cumulative_cost) AS total_cost,
           max(ending_inventory) AS peak_inventory,
           round(avg(capacity_utilization_pct), 4) AS mean_capacity_utilization_pct,
           first(fiscal_month ORDER BY recommended_production DESC, period)
             AS peak_production_month,
           first(fiscal_month ORDER BY ending_inventory DESC, period) AS peak_inventory_month,
           max(warehouse_utilization_pct) < 100 AS overflow_avoided
    FROM schedule GROUP BY scenario_id, scenario_code, product_id""",
    **PRODUCT_PLAN,
    schedule=SCHEDULE,
)
ORACLES["stored_build_plan"] = sql(
    """
    SELECT scenario_name, fiscal_month, fiscal_quarter, 'LP_v1.0_20240901' AS model_version,
           count(*) AS row_count, CAST(sum(recommended_production) AS DOUBLE) AS quantity,
           CAST(sum(ending_inventory) AS DOUBLE) AS inventory,
           CAST(sum(CAST(recommended_production AS DECIMAL(18,2))
                    + CAST(ending_inventory * 0.22 AS DECIMAL(18,2))) AS DOUBLE) AS cost,
           CAST(0.95 AS DOUBLE) AS confidence
    FROM schedule JOIN scenario USING (scenario_id) GROUP BY ALL""",
    **PRODUCT_PLAN,
    schedule=SCHEDULE,
)
ORACLES["stored_product_plans"] = sql(
    """
    SELECT row_number() OVER (ORDER BY scenario_id, make_date(2024, period, 1), product_id) AS plan_rank,
           scenario_id, product_id, fiscal_month,
           CAST(recommended_production AS DOUBLE) AS quantity,
           CAST(ending_inventory AS DOUBLE) AS inventory
    FROM schedule WHERE scenario_id = 2""",
    **PRODUCT_PLAN,
    schedule=SCHEDULE,
)
ORACLES["all_units"] = """
    SELECT CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS units
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"""

# Metrics ---------------------------------------------------------------------

ORACLES["warehousing_cost_october"] = sql(
    f"""
    SELECT scenario_code, {d2("sum(projected_warehousing_cost)", "total_warehousing_cost")}
    FROM comparison WHERE fiscal_month = 'October' GROUP BY scenario_code"""
)
ORACLES["margin_impact"] = sql(
    f"""
    SELECT scenario_code, {d4("revenue - cost", "total_gross_margin")},
           {d2("storage", "total_warehousing_cost")},
           {d4("revenue - cost - storage", "net_margin_after_storage")}
    FROM kpis""",
    kpis=KPIS.format(rates="cost"),
)
ORACLES["margin_percentages"] = sql(
    f"""
    SELECT scenario_code, {d4("revenue - cost", "total_gross_margin")},
           {half_up("((revenue - cost) * 100)", "revenue")} AS gross_margin_pct
    FROM kpis""",
    kpis=KPIS.format(rates="cost"),
)
ORACLES["revenue_by_family"] = sql(
    f"""
    SELECT scenario_code, product_family, {d2("sum(total_revenue)", "total_forecasted_revenue")}
    FROM comparison GROUP BY ALL"""
)
ORACLES["regional_storage"] = sql(
    f"""
    SELECT scenario_code, fiscal_month,
           {d2("sum(projected_warehousing_cost)", "total_warehousing_cost")}
    FROM comparison WHERE region = 'ASIA' GROUP BY ALL"""
)
ORACLES["overflow_risk"] = sql(
    """
    SELECT zone_name, site_name, region, projected_utilization_pct FROM utilisation
    WHERE scenario_code = 'Q4_PUSH' AND is_overflow_risk""",
    projected=PROJECTED.format(units="demand"),
    utilisation=UTILISATION,
)
ORACLES["region_quarter_demand"] = sql(
    f"""
    SELECT region, fiscal_quarter, {d4("sum(forecast_quantity)", "total_forecasted_quantity")}
    FROM comparison WHERE scenario_code = 'BASELINE' GROUP BY ALL"""
)
ORACLES["top_families"] = sql(
    f"""
    SELECT scenario_code, product_family, {d2("sum(total_revenue)", "total_forecasted_revenue")},
           {d4("sum(forecast_quantity)", "total_forecasted_quantity")}
    FROM comparison GROUP BY ALL
    ORDER BY sum(total_revenue) DESC NULLS FIRST, scenario_code, product_family NULLS LAST LIMIT 20"""
)


def _golden(name: str, oracle: str, status: str = "PASSED", differing: str = "false") -> str:
    return f"""
    SELECT '{name}' AS query_name, '{status}' AS status, count(*) AS row_count,
           count(*) FILTER ({differing}) AS missing_rows,
           count(*) FILTER ({differing}) AS unexpected_rows
    FROM ({ORACLES[oracle]})"""


ORACLES["golden_queries"] = " UNION ALL ".join(
    [
        _golden("warehousing_cost_by_scenario_october", "warehousing_cost_october"),
        _golden("margin_impact_q4_push", "margin_percentages", "NOT_RUN"),
        _golden("warehouse_overflow_risk", "overflow_risk"),
        _golden("revenue_by_product_family", "revenue_by_family", "FAILED", "scenario_code = 'BASELINE'"),
        _golden("margin_impact_comparison", "margin_impact"),
        _golden("northeast_capacity_impact", "regional_storage"),
    ]
)
ORACLES["all_metrics"] = sql(
    f"""
    SELECT scenario_code, region, fiscal_quarter,
           {d2("sum(total_revenue)", "total_forecasted_revenue")},
           {d4("sum(forecast_quantity)", "total_forecasted_quantity")},
           {d2("sum(projected_warehousing_cost)", "total_warehousing_cost")},
           {d4("sum(gross_margin)", "total_gross_margin")},
           round(CAST(sum(gross_margin) AS DOUBLE) / CAST(sum(total_revenue) AS DOUBLE) * 100, 6)
             AS gross_margin_percentage,
           round(CAST(sum(confidence_level) AS DOUBLE) / count(confidence_level), 6)
             AS average_confidence,
           {d4("sum(gross_margin) - sum(projected_warehousing_cost)",
               "net_margin_after_warehousing")}
    FROM comparison WHERE fiscal_quarter = 'Q4' GROUP BY ALL"""
)
ORACLES["metric_facts"] = sql(
    f"""
    SELECT product_id, site_code, forecast_date,
           CAST(forecast_quantity AS DOUBLE) AS forecast_quantity,
           {d4("gross_margin", "gross_margin")},
           CAST(projected_warehousing_cost AS DOUBLE) AS projected_warehousing_cost,
           CAST(confidence_level AS DOUBLE) AS confidence_level
    FROM comparison WHERE scenario_code = 'Q4_PUSH' AND fiscal_month = 'October'"""
)

# Quality ---------------------------------------------------------------------

ORACLES["table_profile"] = sql(
    """
    SELECT 'product_category' AS table_name,
           (SELECT count(*) FROM leaf) + (SELECT count(DISTINCT p_brand) FROM part) + 1
             AS row_count
    UNION ALL SELECT 'product', count(*) + count(*) FILTER (p_partkey % 10 = 0) FROM part
    UNION ALL SELECT 'site', count(*) + count(*) FILTER (n_nationkey % 4 = 0) FROM nation
    UNION ALL SELECT 'work_center', count(*) + count(*) FILTER (s_suppkey % 6 = 0) FROM supplier
    UNION ALL SELECT 'warehouse_zone', count(*) + count(*) FILTER (warehouse_zone_id % 8 = 0)
              FROM zone
    UNION ALL SELECT 'scenario_definition', count(*) FROM scenario
    UNION ALL SELECT 'demand_forecast_versions', count(*) FROM versions
    UNION ALL SELECT 'logistics_cost_fact', count(*) + count(*) FILTER (warehouse_zone_id % 9 = 0)
              FROM cost
    UNION ALL SELECT 'inventory_balance', count(*) FROM part"""
)
ORACLES["catalog_profile"] = sql(
    """
    SELECT 'SCENARIO_COMPARISON_V' AS table_name, 'MART' AS schema_name,
           'VIEW' AS object_type, 'Main fact table for scenario analysis' AS description,
           count(*) AS row_count FROM comparison
    UNION ALL SELECT 'DT_SCENARIO_KPI_SUMMARY', 'MART', 'DYNAMIC TABLE',
                     'Aggregated KPIs by scenario', count(DISTINCT scenario_id) FROM line
    UNION ALL SELECT 'WAREHOUSE_UTILIZATION_PROJECTION', 'MART', 'VIEW',
                     'Warehouse capacity projections', count(*) FROM projected
    UNION ALL SELECT 'INVENTORY_BUILDUP_CURVE', 'MART', 'VIEW',
                     'Time-series inventory positions', count(*)
              FROM (SELECT DISTINCT scenario_id, fiscal_month FROM forecast)""",
    projected=PROJECTED.format(units="demand"),
)
ORACLES["expectations"] = sql(
    """
    SELECT *, row_count >= min_rows AS passed FROM (
        SELECT 'table_totals' AS query_name, 'Totals over all planning tables' AS description,
               CAST(1 AS BIGINT) AS min_rows, CAST(1 AS BIGINT) AS row_count
        UNION ALL SELECT 'quarter_totals', 'Demand, revenue and cost of each quarter', 1, count(*)
        FROM (SELECT DISTINCT scenario_code, fiscal_quarter FROM line)
        UNION ALL SELECT 'site_storage', 'Storage cost of each site in each scenario', 1, count(*)
        FROM (SELECT DISTINCT scenario_code, site_name FROM line)
        UNION ALL SELECT 'month_totals', 'Units of each month in each scenario', 19, count(*)
        FROM (SELECT DISTINCT scenario_code, fiscal_month FROM line))"""
)
_CHECKS = {
    "PRIMARY KEY": (
        "product_category.product_category_id product.product_id site.site_id "
        "work_center.work_center_id warehouse_zone.warehouse_zone_id "
        "scenario_definition.scenario_id logistics_cost_fact.logistics_cost_id "
        "inventory_balance.inventory_balance_id"
    ),
    "NOT NULL": (
        "product_category.product_category_id product.product_id site.site_id "
        "work_center.work_center_id warehouse_zone.warehouse_zone_id "
        "scenario_definition.scenario_id demand_forecast_versions.demand_forecast_id "
        "logistics_cost_fact.logistics_cost_id inventory_balance.inventory_balance_id"
    ),
    "FOREIGN KEY": (
        "product_category.parent_category_id product.product_category_id work_center.site_id "
        "warehouse_zone.site_id scenario_definition.parent_scenario_id "
        "demand_forecast_versions.site_id demand_forecast_versions.scenario_id "
        "logistics_cost_fact.site_id logistics_cost_fact.warehouse_zone_id "
        "inventory_balance.product_id inventory_balance.site_id "
        "inventory_balance.warehouse_zone_id"
    ),
    "ALLOWED VALUES": (
        "product.product_type product.product_status site.site_type site.operating_status "
        "work_center.work_center_type warehouse_zone.zone_type scenario_definition.scenario_type"
    ),
}
_CLEAN = ",\n           ".join(
    "('{}', '{}', '{}')".format(kind, *name.split("."))
    for kind, names in _CHECKS.items()
    for name in names.split()
)
ORACLES["constraint_report"] = sql(
    f"""
    SELECT constraint_type, table_name, column_name, CAST(0 AS BIGINT) AS violations
    FROM (VALUES {_CLEAN}) AS clean(constraint_type, table_name, column_name)
    UNION ALL
    SELECT unnest(['PRIMARY KEY', 'FOREIGN KEY', 'ALLOWED VALUES']), 'demand_forecast_versions',
           unnest(['demand_forecast_id', 'product_id', 'forecast_type']), count(*)
    FROM versions WHERE site_id = 3"""
)
ORACLES["golden_checks"] = sql(
    """
    SELECT query_name, status, CAST(rows AS BIGINT) AS missing_rows,
           CAST(rows AS BIGINT) AS unexpected_rows
    FROM (SELECT 'same' AS query_name, 'PASSED' AS status, 0 AS rows
          UNION ALL SELECT 'open', 'NOT_RUN', 0
          UNION ALL SELECT 'changed', 'FAILED', (
              SELECT sum(n) FROM (
                  SELECT greatest(0, coalesce(a.n, 0) - coalesce(b.n, 0)) AS n
                  FROM (SELECT product_id, forecast_quantity AS q, count(*) AS n FROM versions
                        WHERE site_id = 3 GROUP BY ALL) a
                       FULL JOIN (SELECT product_id, forecast_quantity + 1 AS q, count(*) AS n
                                  FROM versions WHERE site_id = 3 GROUP BY ALL) b
                       USING (product_id, q))))"""
)
DOCUMENT = """
    SELECT doc_id AS document_id, DATE '2024-01-01' AS effective_date,
           CASE WHEN doc_id % 2 = 0 THEN DATE '2024-12-31' END AS expiry_date, text,
           CASE WHEN doc_id % 7 = 0 THEN 'contracts' ELSE source END AS folder,
           CASE doc_id % 6 WHEN 0 THEN 'northeast_3pl_contract_' || doc_id || '.pdf'
                WHEN 1 THEN 'Warehouse_capacity_SLA_' || doc_id || '.PDF'
                WHEN 2 THEN 'sop_meeting_minutes_' || doc_id || '.docx'
                WHEN 3 THEN 'acme_west_' || doc_id || '.pdf'
                WHEN 4 THEN 'acme_contract_notes_' || doc_id || '.txt'
                ELSE 'report_' || doc_id || '.pdf' END AS file_name
    FROM documents"""
ORACLES["text_lengths"] = sql(
    """
    SELECT 'text' AS column_name, count(*) FILTER (length(text) > 16000) AS violations
    FROM document
    UNION ALL
    SELECT 'relative_path', count(*) FILTER (length(folder || '/' || file_name) > 30)
    FROM document""",
    document=DOCUMENT,
)

# Documents -------------------------------------------------------------------

CLASSIFIED = """
    SELECT document_id, effective_date, expiry_date, folder || '/' || file_name AS file_path,
           file_name,
           CASE document_id % 6 WHEN 0 THEN 'CONTRACT' WHEN 1 THEN 'SLA'
                WHEN 2 THEN 'MEETING_MINUTES' ELSE 'OTHER' END AS document_type,
           CASE document_id % 6 WHEN 0 THEN 'Northeast 3PL' WHEN 3 THEN 'ACME Logistics'
                ELSE 'Unknown' END AS vendor_name,
           CASE document_id % 6 WHEN 0 THEN 'Northeast' WHEN 3 THEN 'West'
                ELSE 'National' END AS region
    FROM document WHERE document_id % 6 <> 4"""
ORACLES["classified_documents"] = sql(CLASSIFIED, document=DOCUMENT)
ORACLES["classified_documents_deploy"] = sql(
    """
    SELECT document_id, effective_date, expiry_date, folder || '/' || file_name AS file_path,
           file_name,
           CASE WHEN folder = 'contracts' OR document_id % 6 = 0 THEN 'CONTRACT'
                WHEN document_id % 6 = 1 THEN 'SLA' ELSE 'OTHER' END AS document_type,
           CASE WHEN document_id % 6 = 0 THEN 'Northeast 3PL' ELSE 'National' END AS vendor_name,
           CASE WHEN document_id % 6 = 0 THEN 'Northeast' ELSE 'National' END AS region
    FROM document WHERE document_id % 6 NOT IN (2, 4)""",
    document=DOCUMENT,
)
CHUNK = """
    SELECT document_id, folder, file_name, i // 500 + 1 AS chunk_index,
           array_to_string(words[i + 1 : i + 500], ' ') AS chunk_text
    FROM (SELECT document_id, folder, file_name, words,
                 unnest(range(0, len(words), 500)) AS i
          FROM (SELECT document_id, folder, file_name,
                       regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS words
                FROM document))"""
ORACLES["document_chunks"] = sql(
    """
    SELECT document_id, chunk_index, chunk_text, CAST(1 AS BIGINT) AS page_number,
           row_number() OVER (ORDER BY document_id, chunk_index) AS chunk_id
    FROM chunk""",
    document=DOCUMENT,
    chunk=CHUNK,
)
ORACLES["document_load_twice"] = sql(
    """
    SELECT loads.k * (SELECT count(*) FROM classified) + row_number() OVER (PARTITION BY loads.k ORDER BY file_path)
               AS document_id,
           file_path, file_name, document_type, vendor_name, region, n_chunks, n_chars,
           loads.k * (SELECT sum(n_chunks) FROM cut)
               + coalesce(sum(n_chunks) OVER (PARTITION BY loads.k ORDER BY file_path
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1
               + CASE WHEN n_chunks IS NULL THEN NULL ELSE 0 END AS first_chunk_id,
           'Processed ' || (SELECT count(*) FROM classified) || ' files, created '
               || 2 * (SELECT sum(n_chunks) FROM cut) || ' chunks' AS receipt
    FROM classified LEFT JOIN cut USING (document_id) CROSS JOIN (SELECT unnest([0, 1]) AS k) loads""",
    document=DOCUMENT,
    chunk=CHUNK,
    classified=CLASSIFIED,
    cut="""
    SELECT document_id, count(*) AS n_chunks, sum(length(chunk_text)) AS n_chars
    FROM chunk WHERE document_id % 6 <> 4 GROUP BY document_id""",
)
ORACLES["document_chunks_whole"] = sql(
    """
    SELECT document_id, folder || '/' || d.file_name AS relative_path,
           CAST(1 AS BIGINT) AS chunk_index, text AS chunk_text,
           CAST(1 AS BIGINT) AS page_number,
           row_number() OVER (ORDER BY document_id) AS chunk_id, c.file_name, file_path,
           document_type, vendor_name, region, c.effective_date, c.expiry_date
    FROM document d JOIN classified c USING (document_id)""",
    document=DOCUMENT,
    classified=CLASSIFIED,
)


def search_ctes(corpus: str) -> dict[str, str]:
    """BM25 over a corpus of chunks, with the benchmark texts as queries."""
    return {
        "document": DOCUMENT,
        "chunk": CHUNK,
        "corpus": corpus,
        "token": """
            SELECT chunk_id, t AS term
            FROM (SELECT chunk_id, unnest(regexp_split_to_array(lower(chunk_text),
                                                                '[^\\p{L}\\p{N}]+')) AS t
                  FROM corpus) WHERE t <> ''""",
        "lengths": """
            SELECT chunk_id, count(term) AS n
            FROM corpus LEFT JOIN token USING (chunk_id) GROUP BY chunk_id""",
        "asked": """
            SELECT DISTINCT query_id, term
            FROM (SELECT item_id AS query_id, unnest(regexp_split_to_array(lower(text),
                                                     '[^\\p{L}\\p{N}]+')) AS term FROM benchmark)
            WHERE term <> ''""",
        "posting": """
            SELECT chunk_id, term, count(*) AS tf FROM token
            WHERE term IN (SELECT term FROM asked) GROUP BY ALL""",
        "stats": "SELECT count(*) AS chunks, avg(n) AS mean_length FROM lengths",
        "weights": """
            SELECT term, ln(1 + ((SELECT chunks FROM stats) - count(*) + 0.5)
                                / (count(*) + 0.5)) AS idf
            FROM posting GROUP BY term""",
        "scored": """
            SELECT query_id, chunk_id, round(sum(
                     idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean_length))), 6) AS score
            FROM asked JOIN posting USING (term) JOIN weights USING (term)
                 JOIN lengths USING (chunk_id) CROSS JOIN stats
            GROUP BY ALL""",
        "ranked": """
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id
                                              ORDER BY score DESC, chunk_id) AS INT) AS "rank"
            FROM scored""",
    }


_KEYED = """
    SELECT document_id || '#' || chunk_index AS chunk_id, folder,
           folder || '/' || file_name AS relative_path, chunk_text FROM chunk"""
ORACLES["search"] = sql(
    """
    SELECT query_id, "rank", chunk_id, score, relative_path, chunk_text
    FROM ranked JOIN corpus USING (chunk_id) WHERE "rank" <= 5""",
    **search_ctes(_KEYED),
)
ORACLES["search_filtered"] = sql(
    """
    SELECT query_id, "rank", chunk_id, score, relative_path AS file_path
    FROM ranked JOIN corpus USING (chunk_id) WHERE "rank" <= 2""",
    **search_ctes(_KEYED + " WHERE file_name LIKE 'northeast_3pl_contract%'"),
)
ORACLES["stream_search"] = sql(
    """SELECT query_id, chunk_id, score, "rank" FROM ranked WHERE "rank" <= 5""",
    **search_ctes(_KEYED),
)

ORACLES["stream_search_updates"] = ORACLES["search"]
ORACLES["stream_search_filtered"] = ORACLES["search_filtered"]

# Ingest ----------------------------------------------------------------------

INGESTED = """
    SELECT p_partkey AS product_id, 'P-' || p_partkey AS product_code, p_name AS product_name,
           'size "' || p_size || '", ' || p_type AS product_description_short,
           'FINISHED_GOOD' AS product_type,
           CASE WHEN p_size % 5 <> 0 THEN 'ACTIVE' END AS product_status,
           leaf_id AS product_category_id,
           CAST({price} AS DOUBLE) AS unit_price,
           CASE WHEN p_size % 7 > 1 THEN CAST({cost} AS DOUBLE) END AS unit_cost,
           TRUE AS is_current_flag, 'system' AS created_by_user
    FROM part JOIN leaf USING (p_brand, p_type) WHERE p_partkey % 50 <> 49"""
ORACLES["ingest_products"] = sql(
    INGESTED.format(
        price="CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(18,0))",
        cost="CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 0.6 AS DECIMAL(18,0))",
    )
)
ORACLES["ingest_products_declared"] = sql(
    INGESTED.format(
        price="CAST(p_retailprice AS DECIMAL(18,4))",
        cost="CAST(p_retailprice AS DECIMAL(18,2)) * 0.6",
    )
)
ORACLES["ingest_forecasts"] = """
    SELECT l_orderkey * 8 + l_linenumber AS demand_forecast_id,
           CAST(l_linenumber % 3 + 1 AS BIGINT) AS scenario_id, l_partkey AS product_id,
           l_suppkey % 25 AS site_id,
           CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) END AS forecast_date,
           year(l_shipdate) AS fiscal_year, monthname(l_shipdate) AS fiscal_month,
           'Q' || quarter(l_shipdate) AS fiscal_quarter, CAST(NULL AS VARCHAR) AS fiscal_period,
           CAST(CAST(l_quantity AS DECIMAL(12,0)) + 1 AS DOUBLE) AS forecast_quantity,
           CAST(1 AS DOUBLE) AS confidence_level,
           CAST((CAST(l_quantity AS DECIMAL(12,0)) + 1) * CAST(CAST(l_extendedprice
                AS DECIMAL(12,2)) AS DECIMAL(12,0)) AS DOUBLE) AS total_revenue
    FROM lineitem"""
ORACLES["ingest_categories"] = sql(
    """
    SELECT CAST(1 AS BIGINT) AS product_category_id, 'ALL' AS product_category_code,
           'All Products' AS category_name, CAST(NULL AS VARCHAR) AS category_description,
           CAST(NULL AS BIGINT) AS parent_category_id, CAST(1 AS BIGINT) AS category_level
    UNION ALL
    SELECT DISTINCT (leaf_id - 1000) // 10 + 10, p_brand, p_brand, NULL, 1, 2 FROM leaf
    UNION ALL
    SELECT leaf_id, p_brand || ' ' || p_type, p_brand || ' ' || p_type, NULL,
           (leaf_id - 1000) // 10 + 10, 3
    FROM leaf"""
)
ORACLES["ingest_sites"] = sql(
    """
    SELECT site_id, site_code, site_name, site_type, region,
           CAST(NULL AS VARCHAR) AS address_line_1, CAST(NULL AS VARCHAR) AS city,
           CAST(NULL AS VARCHAR) AS state_province, n_name AS country,
           'ACTIVE' AS operating_status, CAST(1000 + site_id * 10 AS DOUBLE) AS capacity_metric,
           CASE site_type WHEN 'PLANT' THEN 'UNITS_PER_MONTH' ELSE 'PALLETS' END
             AS capacity_unit_of_measure
    FROM site JOIN nation ON n_nationkey = site_id"""
)
ORACLES["rejected_lines"] = """
    SELECT CAST(p_partkey AS VARCHAR) AS key, (p_partkey % 2) || '_products.csv' AS source_file,
           CASE p_partkey % 2 WHEN 0 THEN p_partkey || ',' || p_name ELSE p_name || ',' || p_partkey END
               || CASE WHEN p_partkey % 5 <> 0 THEN ',' || p_brand ELSE '' END
               || CASE WHEN p_partkey % 7 = 0 THEN ',surplus' ELSE '' END AS line
    FROM part WHERE (p_partkey % 5 = 0) <> (p_partkey % 7 = 0)"""
ORACLES["second_load"] = """
    SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name,
           CAST(CASE p_partkey % 3 WHEN 2 THEN 2 ELSE 1 END AS BIGINT) AS load_number,
           row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) AS row_number
    FROM part"""
ORACLES["ingest_work_centers"] = sql(
    """
    SELECT work_center_id, work_center_code, work_center_name,
           CAST(NULL AS VARCHAR) AS work_center_description, work_center_type, site_id,
           CAST(capacity_per_hour AS DOUBLE) AS capacity_per_hour,
           CAST(hours_per_day AS DOUBLE) AS hours_per_day,
           CAST(available_shifts AS BIGINT) AS available_shifts,
           CAST(efficiency_factor AS DOUBLE) AS efficiency_factor
    FROM work_center"""
)
ORACLES["ingest_zones"] = sql(
    """
    SELECT warehouse_zone_id, zone_code, zone_name, site_id, zone_type,
           'AMBIENT' AS zone_temperature_control, max_capacity_pallets, current_occupancy_pallets
    FROM zone"""
)
ORACLES["ingest_scenarios"] = sql(
    """
    SELECT scenario_id, scenario_code, scenario_name,
           'About' || chr(10) || '"' || scenario_name || '"' AS scenario_description,
           scenario_type, is_official_baseline, 'system' AS created_by_user
    FROM scenario"""
)
ORACLES["ingest_costs"] = sql(
    """
    SELECT logistics_cost_id, site_id, warehouse_zone_id,
           CAST(storage_rate AS DOUBLE) AS storage_cost_per_pallet_per_day,
           CAST((15 + warehouse_zone_id % 20) * 0.01 AS DOUBLE) AS transport_cost_per_unit,
           CAST((356 + warehouse_zone_id % 300) * 0.01 AS DOUBLE) AS handling_cost_per_pallet,
           CAST(overflow_penalty_rate AS DOUBLE) AS overflow_penalty_rate,
           CAST(overflow_penalty_threshold_pct AS DOUBLE) AS overflow_penalty_threshold_pct,
           DATE '2024-01-01' AS effective_date, DATE '2024-12-31' AS expiry_date,
           'Vendor ' || site_id AS vendor_name, '3PL-' || warehouse_zone_id AS contract_reference
    FROM cost"""
)
ORACLES["ingest_inventory"] = """
    SELECT p_partkey + 1 AS inventory_balance_id, p_partkey AS product_id,
           p_partkey % 25 AS site_id,
           CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 25 * 100 + 1 END AS warehouse_zone_id,
           DATE '2024-09-01' AS balance_date, CAST(p_size * 30 AS DOUBLE) AS quantity_on_hand,
           CAST(p_size * 4 AS DOUBLE) AS quantity_reserved,
           CAST(p_size * 26 AS DOUBLE) AS quantity_available, 'EACH' AS unit_of_measure
    FROM part"""
ORACLES["staged_load"] = sql(
    """
    SELECT 'product_category_stage' AS table_name,
           (SELECT count(*) FROM leaf) + (SELECT count(DISTINCT p_brand) FROM part) + 1
             AS row_count
    UNION ALL SELECT 'product_stage', count(*) FROM part
    UNION ALL SELECT 'site_stage', count(*) FROM nation
    UNION ALL SELECT 'work_center_stage', count(*) FROM supplier
    UNION ALL SELECT 'warehouse_zone_stage', count(*) FROM zone
    UNION ALL SELECT 'scenario_definition_stage', count(*) FROM scenario
    UNION ALL SELECT 'demand_forecast_versions_stage', count(*) FROM forecast
    UNION ALL SELECT 'logistics_cost_fact_stage', count(*) FROM cost
    UNION ALL SELECT 'inventory_balance_stage', count(*) FROM part"""
)
ORACLES["ingest_all"] = ORACLES["scenario_kpis"]
ORACLES["usable_values"] = """
    SELECT event_id, CASE WHEN event_id % 5 > 2 THEN coalesce(value, 0) ELSE 0 END AS value
    FROM events"""
ORACLES["raw_reload"] = """
    SELECT 2 * count(*) AS row_count, CAST(0 AS BIGINT) AS named, 'append' AS mode FROM part
    UNION ALL
    SELECT count(*), 0, 'overwrite' FROM part"""
ORACLES["stored_tables"] = ORACLES["scenario_kpis"]

# Streaming -------------------------------------------------------------------

EVENT_LINES = f"""
    SELECT event_id, user_id AS product_id, event_id % 25 AS site_id,
           user_id % 3 + 1 AS scenario_id, date_trunc('day', ts) AS version_timestamp,
           CAST(value AS DECIMAL(18,4)) AS forecast_quantity,
           CAST(CAST(value AS DECIMAL(18,4)) * (user_id % 50 + 10) AS DECIMAL(18,2))
             AS total_revenue,
           {MONTHS}[event_id % 6 + 1] AS fiscal_month,
           date_trunc('day', ts) = max(date_trunc('day', ts)) OVER (PARTITION BY user_id % 3)
             AS is_current_version
    FROM events"""
ORACLES["stream_versions"] = sql(
    f"""
    SELECT scenario_id, is_current_version,
           CAST(version_timestamp AS TIMESTAMP) AS version_timestamp, product_id, site_id,
           fiscal_month, {d4("forecast_quantity", "forecast_quantity")},
           {d2("total_revenue", "total_revenue")}
    FROM event_line""",
    event_line=EVENT_LINES,
)
ORACLES["stream_kpis"] = sql(
    KPI_COLUMNS,
    event_line=EVENT_LINES,
    forecast="SELECT * FROM event_line WHERE is_current_version",
    kpis=KPIS.format(rates="cost"),
)
ORACLES["stream_kpis_base"] = sql(
    KPI_COLUMNS,
    forecast="""
        SELECT *, CAST(forecast_quantity * unit_revenue AS DECIMAL(18,2)) AS total_revenue
        FROM versions WHERE is_current_version AND demand_forecast_id % 11 <> 5""",
    product=f"""
        SELECT * REPLACE (CAST(CASE WHEN product_id % 7 = 0 THEN unit_cost + 1.25 ELSE unit_cost END
                               AS DECIMAL(18,4)) AS unit_cost)
        FROM ({BASE["product"]}) WHERE product_id % 13 <> 4 OR product_id % 7 = 0""",
    site=f"SELECT * FROM ({BASE['site']}) WHERE site_id % 8 <> 6",
    scenario=f"""
        SELECT * REPLACE (CASE WHEN scenario_id = 3 THEN 'Cautious Estimate' ELSE scenario_name END
                          AS scenario_name)
        FROM ({BASE["scenario"]})""",
    raised="""
        SELECT * REPLACE (CAST(CASE WHEN site_id % 4 = 1 THEN storage_rate + 1 ELSE storage_rate END
                               AS DECIMAL(18,4)) AS storage_rate) FROM cost""",
    kpis=KPIS.format(rates="raised"),
)
ORACLES["stream_kpis_all"] = sql(
    KPI_COLUMNS,
    event_line=EVENT_LINES,
    forecast="""
        SELECT scenario_id, product_id, site_id, forecast_quantity, total_revenue, fiscal_month
        FROM event_line WHERE is_current_version AND scenario_id = 2
        UNION ALL
        SELECT scenario_id, product_id, site_id, forecast_quantity, total_revenue, fiscal_month
        FROM (SELECT *, CAST(forecast_quantity * unit_revenue AS DECIMAL(18,2)) AS total_revenue
              FROM versions WHERE is_current_version AND scenario_id <> 2)""",
    raised="SELECT * REPLACE (CAST(storage_rate + 1 AS DECIMAL(18,4)) AS storage_rate) FROM cost",
    kpis=KPIS.format(rates="raised"),
)
