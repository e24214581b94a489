"""Tables of sums that change by signed amounts, one folder per micro-batch.

A batch only adds its own changes; the state is the sum of all folders. Replaying
a batch overwrites its folder and reads only folders before it, so nothing counts
twice. ``merge`` sums the folders so far into one, so a read opens a bounded
number of them however long the stream has run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.durable import shuffles_released

#: Folders above the last merged one at which the next merge is due.
MERGE_AT = 8
#: So many tasks more deal a bucket out to one part more.
TASKS_PER_PART = 16


@dataclass(frozen=True, eq=False)
class SignedTable:
    """Sums by key. ``buckets`` names the keys that also part the files.

    Rows of such a table are summed where their files are written, so that they
    are shuffled once; the rows of one folder come from a few tasks.
    """

    name: str
    keys: dict[str, str]
    sums: dict[str, str]
    buckets: tuple[str, ...] = field(default=())

    @property
    def schema(self) -> str:
        return ", ".join(f"{n} {kind}" for n, kind in {**self.keys, **self.sums}.items())

    def summed(self, rows: DataFrame) -> DataFrame:
        """One row per key whose sums aren't all zero; a null adds nothing."""
        keys = list(self.keys)
        if self.buckets:
            tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            part = F.pmod(F.xxhash64(*keys), F.lit(max(1, tasks // TASKS_PER_PART)))
            rows = rows.withColumn("_part", part).repartition(*self.buckets, "_part")
            keys.append("_part")
        found = rows.groupBy(*keys).agg(
            *[F.coalesce(F.sum(n), F.lit(0)).cast(kind).alias(n) for n, kind in self.sums.items()]
        )
        changed = F.lit(False)
        for n in self.sums:
            changed = changed | (F.col(n) != 0)
        return found.where(changed).select(*self.keys, *self.sums)

    def _write(self, rows: DataFrame, path: str) -> None:
        with shuffles_released(rows.sparkSession):
            rows.write.mode("overwrite").option("compression", "zstd").partitionBy(
                *self.buckets
            ).parquet(path)

    def folder(self, root: str, batch_id: int) -> str:
        """Where the changes of a batch lie."""
        return f"{root}/{self.name}/level=batch-{batch_id}"

    def own(self, spark: SparkSession, root: str, batch_id: int) -> DataFrame:
        """The changes of one batch."""
        found = spark.read.schema(self.schema).parquet(self.folder(root, batch_id))
        return found.select(*self.keys, *self.sums)

    def add(self, rows: DataFrame, root: str, batch_id: int) -> None:
        """Store the changes of a batch."""
        self._write(self.summed(rows), self.folder(root, batch_id))

    def folders(self, spark: SparkSession, root: str, before: int | None = None) -> list[tuple[str, int]]:
        """The folders that make up the state before a batch, as ``(path, batch)``.

        The latest merged folder comes first, then the batches after it. A folder
        counts once its job is committed.
        """
        top = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{self.name}")
        files = top.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(top):
            return []
        found: dict[str, list[tuple[int, str]]] = {"batch": [], "upto": []}
        for status in files.listStatus(top):
            path = status.getPath()
            kind, _, number = path.getName().removeprefix("level=").partition("-")
            if kind in found and (before is None or int(number) < before):
                done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
                if files.exists(done):
                    found[kind].append((int(number), path.toString()))
        merged = max(found["upto"], default=(-1, ""))
        later = sorted(x for x in found["batch"] if x[0] > merged[0])
        return [(path, number) for number, path in ([merged] if merged[1] else []) + later]

    def rows(
        self, spark: SparkSession, root: str, before: int | None = None, where: Column | None = None
    ) -> DataFrame:
        """All stored changes before a batch, not summed; ``where`` may prune files."""
        paths = [path for path, _ in self.folders(spark, root, before)]
        if not paths:
            return spark.createDataFrame([], self.schema)
        reader = spark.read.schema(self.schema).option("basePath", f"{root}/{self.name}")
        found = reader.parquet(*paths).select(*self.keys, *self.sums)
        return found if where is None else found.where(where)

    def state(
        self, spark: SparkSession, root: str, before: int | None = None, where: Column | None = None
    ) -> DataFrame:
        """The sums before a batch (all of them by default)."""
        return self.summed(self.rows(spark, root, before, where))

    def merge(self, spark: SparkSession, root: str, before: int, at: int = MERGE_AT) -> None:
        """Sum the folders before a batch into one, if ``at`` or more have come.

        The folders that the merge before last replaced are removed; those of
        the last one stay for readers that have begun.
        """
        now = self.folders(spark, root, before)
        if len(now) <= at:
            return
        last = now[-1][1]
        self._write(self.state(spark, root, before), f"{root}/{self.name}/level=upto-{last}")
        floor = now[0][1]
        top = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{self.name}")
        files = top.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in files.listStatus(top):
            path = status.getPath()
            kind, _, number = path.getName().removeprefix("level=").partition("-")
            if (kind == "batch" and int(number) <= floor and "upto-" in now[0][0]) or (
                kind == "upto" and int(number) < floor
            ):
                files.delete(path, True)
