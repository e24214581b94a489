"""Supply-planning analytics as composable Spark DataFrames."""
