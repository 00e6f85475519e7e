"""Session defaults, table loading and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def session(app: str = "ballast", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE, skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # a hot key is split even where the aggregate after the join then needs a shuffle of its own
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def zoned(df: DataFrame) -> DataFrame:
    """Zone-less timestamps read as UTC instants (watermarks refuse the zone-less type)."""
    naive = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return zoned(spark.read.parquet(f"{folder}/{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, for checkpoints and state tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="ballast-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Narrow rows that a task takes before each becomes many or costly ones; bytes of Parquet read per shuffle partition.
FAN_ROWS, PART_BYTES = 25_000, 2 << 20
#: Bytes of shuffled data, as written, that AQE gives to a task at most: in a sort they are about thirty times as many.
TASK_BYTES = 16 << 20


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Spread narrow rows evenly before each becomes many or costly ones.

    One shuffle of the small rows, so that the many are made by all tasks even
    where the input came from few files. The rows are counted first, so that a
    task's share does not grow with the input.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // FAN_ROWS)), *keys)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a path of any file system that Spark knows."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(there).getLength()


def size_shuffles(spark: SparkSession, read: int) -> None:
    """Let the number of shuffle partitions grow with the bytes that a query reads.

    Where AQE merges small partitions, it starts from this many and ends at ``TASK_BYTES``,
    or less where the session names less. A task's share then stays the same for large
    inputs, and small ones are merged as before.
    """
    named = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(named) > TASK_BYTES:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", f"{TASK_BYTES}b")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(least, -(-read // PART_BYTES))))


#: Rows of a narrow frame that a join may send whole to every task; the driver gathers them first.
SENT_ROWS = 500_000


def sent_if_few(df: DataFrame) -> DataFrame:
    """``df`` as a join's right side: sent whole where it has at most ``SENT_ROWS`` rows, else dealt by the join's key.

    Spark goes by the compressed size of the files and the share of the columns read, and so may
    have the driver gather millions of narrow rows. The rows are counted here instead.
    """
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df.hint("merge")


def run_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_folder(spark)}/ballast/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    The result has a short plan, survives lost executors, and has a known size,
    so that later joins may choose to broadcast it.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_cuts(spark: SparkSession) -> None:
    """Delete the tables that this application's ``cut`` calls left behind; call it last."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
