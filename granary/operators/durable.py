"""Where intermediate results live so that a lost executor costs nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local-mode session, where all tasks share one machine, may fall back
    to a fresh temporary folder.
    """
    named = spark.conf.get(_SETTING, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="granary-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for one run that nothing else writes to."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Each query run inside gives its shuffle files back when it ends.

    Else they stay until the driver happens to collect its garbage, and the disks
    hold the shuffles of all steps at once.
    """
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows as a table in the shared folder, whose measured size Spark plans with."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_released(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are fixed and survive executor loss."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
