"""Derived tables that many queries share, written once per application.

They go below the folder the session names in ``spark.checkpoint.dir``, or below its warehouse.
Readers then start from files: a lost executor costs a re-read, not the chain of joins behind the
table, and pruning and pushdown apply to it like to any input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_DIR = "spark.checkpoint.dir"
WAREHOUSE_DIR = "spark.sql.warehouse.dir"


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, or else the warehouse; an error if other machines cannot see it.

    Whether a ``file:`` folder is a mount that all machines share does not show in its name, so on a
    cluster the first use of one tries it.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get(WAREHOUSE_DIR)
    _, files = _file_system(spark, folder)
    if files.getUri().getScheme() == "file" and not spark.sparkContext.master.startswith("local"):
        used = (spark.sparkContext.applicationId, folder)
        if used not in _tried:
            _try(spark, folder)
            _tried.add(used)
    return folder.rstrip("/")


_tried: set[tuple[str, str]] = set()


def _try(spark: SparkSession, folder: str) -> None:
    """An error unless all rows can be read that tasks, one for each core there is, write into the folder."""
    path = f"{folder.rstrip('/')}/shelfscope-try-{uuid.uuid4().hex}"
    tasks = spark.sparkContext.defaultParallelism
    message = (
        f"files in {folder} are not seen by all machines; set {CHECKPOINT_DIR} to a shared folder, "
        "or name a folder that all machines mount"
    )
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        found = spark.read.schema("id long").parquet(path).count()
    except Exception as failure:
        raise ValueError(message) from failure
    finally:
        delete_folder(spark, path)
    if found != tasks:
        raise ValueError(message)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path, files = _file_system(spark, folder)
    files.delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path, files = _file_system(spark, folder)
    return files.exists(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A stored copy at which lineage ends, in the checkpoint folder.

    ``spark.cleaner.referenceTracking.cleanCheckpoints`` lets Spark delete it when nothing refers to it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def clustered(df: DataFrame, *by: str, within: Sequence[str] = ()) -> DataFrame:
    """Bring equal values together in partitions of the session's advisory size.

    A value with more rows fills several partitions, small ones share one. Written, this lets a
    filter on the value skip files. ``within`` are the folders the files will go to.
    """
    return df.hint("rebalance", *[F.col(c) for c in by]).sortWithinPartitions(*within, *by)


def buckets_for(row_ct: int, largest: int, bucket_rows: int = 500_000, least: int = 8) -> int:
    """How many buckets a table of so many rows gets: a power of two; 0 says not to bucket it.

    A join of bucketed tables is never split, so one key's rows stay in one task. The layout is only
    for tables whose ``largest`` key has no more rows than two average buckets.
    """
    buckets = least
    while buckets * bucket_rows < row_ct:
        buckets *= 2
    return buckets if largest * buckets <= 2 * row_ct or largest * least <= bucket_rows else 0


@dataclass(frozen=True)
class Profile:
    """What a write saw: the table's schema, its rows, and the present values of each column."""

    schema: T.StructType
    row_ct: int
    value_ct: dict[str, int]


def observed(df: DataFrame) -> tuple[DataFrame, Callable[[], Profile]]:
    """The table with counters on it, and what they hold once it has been written: no second scan."""
    seen = Observation()
    present = [F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]
    counted = df.observe(seen, F.count(F.lit(1)).alias("row_ct"), *present)

    def profile() -> Profile:
        found = seen.get
        return Profile(df.schema, found["row_ct"], {c: found[f"c{i}"] for i, c in enumerate(df.columns)})

    return counted, profile


class KeptTables:
    """Names to tables, in a folder of this object's own. A given ``folder`` is taken as shared.

    ``profiles`` has what was counted while each was written.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        base = (folder or shared_folder(spark)).rstrip("/")
        self._spark = spark
        self._id = uuid.uuid4().hex
        self.folder = f"{base}/shelfscope-{self._id}"
        self._tables: dict[str, DataFrame] = {}
        self._named: list[str] = []
        self.profiles: dict[str, Profile] = {}

    def get(
        self,
        name: str,
        build: Callable[[], DataFrame],
        partition_by: Sequence[str] = (),
        bucket_by: Sequence[str] = (),
        buckets: int = 0,
    ) -> DataFrame:
        """The table, built and written at the first call that succeeds.

        With ``bucket_by`` its rows lie in ``buckets`` files by these columns, in order: joins and groups by
        them need no exchange with tables of as many buckets.
        """
        if name not in self._tables:
            table = build()
            path = f"{self.folder}/{name}"
            counted, profile = observed(table)
            writer = counted.write.mode("overwrite").partitionBy(*partition_by)
            if bucket_by:
                known = f"{name}_{self._id}"
                writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by).option("path", path).saveAsTable(known)
                self._named.append(known)
                read = self._spark.table(known)
            else:
                writer.parquet(path)
                read = self._spark.read.schema(table.schema).parquet(path)
            self.profiles[name] = profile()
            self._tables[name] = read.select(*table.columns)
        return self._tables[name]

    def step(self, df: DataFrame) -> DataFrame:
        """A stored copy of a step of a computation, deleted with the rest."""
        path = f"{self.folder}/step-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Delete what was written here; tables that were read from it fail from then on."""
        self._tables = {}
        while self._named:
            self._spark.sql(f"DROP TABLE IF EXISTS {self._named.pop()}")
        delete_folder(self._spark, self.folder)
