"""Fixed values of the planning domain.

Money and rate values are text so that they become exact decimals, never
binary floats.
"""

UNITS_PER_PALLET = 10
STORAGE_DAYS = 30
PENALTY_DAYS = 30
WORKING_DAYS = 22
DEFAULT_STORAGE_RATE = "0.5"
CARRY_COST_PER_UNIT = "0.50"
SITE_CAPACITY_UNITS = 1_000_000

WARNING_PCT = 80
DANGER_PCT = 90
COST_ALERT_PCT = 15

OVERFLOW_THRESHOLD = "0.87"
PRODUCTION_COST = "1.0"
STORAGE_COST = "0.22"
SAFETY_RATIO = "0.15"
MODEL_NAME = "LP_v1.0"
MODEL_CONFIDENCE = "0.95"
PLAN_YEAR = 2024

FISCAL_MONTHS = ("July", "August", "September", "October", "November", "December")
QUARTER_MONTHS = {"Q3": (7, 8, 9), "Q4": (10, 11, 12)}

BASELINE = "BASELINE"
Q4_PUSH = "Q4_PUSH"

ADJUST_PCT_RANGE = (-50, 100)
ADJUST_UNITS_RANGE = (-10_000, 10_000)
