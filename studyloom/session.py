"""Session factory and the shared working folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "studyloom") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STUDYLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "spark-warehouse-local"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor reaches.

    Only a local session may leave it unset; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


_written: list[str] = []


def mark() -> int:
    """The place in the list of written tables, for `release`."""
    return len(_written)


def release(spark: SparkSession, since: int) -> None:
    """Delete the tables written after `since` but the last one; nothing else may read them any more."""
    for path in _written[since:-1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    del _written[since:-1]


def materialize(df: DataFrame, name: str = "step", thin: bool = False, by: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back.

    The result has no lineage, so a lost executor never repeats the work above it, and
    what reads it twice sees the same rows. Parquet keeps column pruning and filters.
    thin: the rows are a few numbers each, so four tasks and files a core are enough.
    by: a column to bucket by, into as many buckets as there are shuffle partitions, so
    that joins on it don't shuffle the table again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    if by:
        n, known = int(spark.conf.get("spark.sql.shuffle.partitions")), f"studyloom_{uuid.uuid4().hex}"
        df.repartition(n, by).write.format("parquet").bucketBy(n, by).option("path", path).saveAsTable(known)
        return spark.table(known)
    (df.coalesce(4 * spark.sparkContext.defaultParallelism) if thin else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: About so many rows are dealt to a task by `spread`.
TASK_ROWS = 500_000


def spread(df: DataFrame, *by: str, rows: int | None = None) -> DataFrame:
    """df dealt by the given columns to as many tasks as its rows need, so that what a task holds doesn't grow with df.

    What then groups, orders or joins by these columns takes no further shuffle. rows: how
    many there are at most; else they are counted, which is cheap for columns of a table.
    """
    n = df.count() if rows is None else rows
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), *by)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
