"""The set of atomic planning tables and where it is stored."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from granary.schemas import ATOMIC, columns_of, struct_of

Source = DataFrame | Callable[[], DataFrame]


class PlanningTables:
    """The nine atomic tables as attributes, each resolved on first use.

    A table may be given as a function, so that a query describes only the
    tables it reads.
    """

    def __init__(self, **sources: Source) -> None:
        unknown = sorted(set(sources) - set(ATOMIC))
        if unknown:
            raise TypeError(f"no such planning tables: {unknown}")
        self._sources = dict(sources)

    def __getattr__(self, name: str) -> DataFrame:
        sources = self.__dict__.get("_sources", {})
        if name not in sources:
            raise AttributeError(name)
        if not isinstance(sources[name], DataFrame):
            sources[name] = sources[name]()
        return sources[name]

    @staticmethod
    def names() -> list[str]:
        return list(ATOMIC)

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in self.names()]

    def with_(self, **changed: Source) -> PlanningTables:
        """The same set with some tables replaced."""
        return PlanningTables(**{**self._sources, **changed})


PARTITIONED_BY = {"demand_forecast_versions": ("scenario_id",)}


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """Store one table as Parquet; ``overwrite`` reloads it, ``append`` adds.

    Forecasts are partitioned by scenario, because every reader and every
    write-back names one. The other tables are dimensions.
    """
    writer = df.write.mode(mode)
    if name in PARTITIONED_BY:
        writer = writer.partitionBy(*PARTITIONED_BY[name])
    writer.parquet(f"{root}/{name}")


def write_tables(tables: PlanningTables, root: str, mode: str = "overwrite") -> None:
    """Store all nine tables below a folder."""
    for name, df in tables.items():
        write_table(df, root, name, mode)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One stored table under its declared schema."""
    columns = columns_of(name)
    return spark.read.schema(struct_of(columns)).parquet(f"{root}/{name}").select(*columns)


def read_tables(spark: SparkSession, root: str) -> PlanningTables:
    """All nine stored tables as lazy scans."""
    return PlanningTables(
        **{n: partial(read_table, spark, root, n) for n in PlanningTables.names()}
    )
