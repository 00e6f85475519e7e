"""Tables and files that jobs leave behind."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.functions.digest import digest_of, group_digest
from ballast.operators.ordered import newest
from ballast.session import cut


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_once(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Results that may never be overwritten; an existing target is an error."""
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def dataset_digest(rows: DataFrame) -> DataFrame:
    """One digest over all rows, free of their order."""
    d = rows.withColumn("_row", digest_of(rows, rows.columns)).withColumn("_all", F.lit(1))
    return group_digest(d, ["_all"], "_row", "digest").select("digest", F.col("digest_rows").alias("rows"))


def publish_dataset(rows: DataFrame, report: DataFrame, version: str, folder: str, registry: DataFrame) -> DataFrame:
    """Write a labeled dataset and its report once; returns the registry row, none if the version is known."""
    base = f"{folder}/{version}"
    if not exists(rows.sparkSession, f"{base}/rows"):
        write_once(rows, f"{base}/rows")
        write_once(report, f"{base}/report", "json")
    row = dataset_digest(rows).select(F.lit(version).alias("dataset_version"), "digest", "rows")
    return row.join(registry.select("dataset_version"), "dataset_version", "left_anti")


# --- latest values -------------------------------------------------------------------


def latest_valid(observations: DataFrame, asof: Column | None = None, retention_s: int | None = None) -> DataFrame:
    """Newest valid observation per provider, type and entity, within the retention time if given."""
    rows = newest(observations.where("valid"), ["provider_key", "observation_type", "entity_id"], ["fetched_at", "observation_id"])
    if asof is not None and retention_s is not None:
        rows = rows.where(F.unix_micros("fetched_at") >= F.unix_micros(asof) - retention_s * 1_000_000)
    return rows


# --- previews and retention ----------------------------------------------------------------

PREVIEW_ROWS = 10


def preview(tables: dict[str, tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """First rows of chosen columns per table, in key order; tables without rows do not appear."""
    out = None
    for name, (df, cols, order) in tables.items():
        top = df.orderBy(*order).limit(PREVIEW_ROWS)
        part = top.select(F.lit(name).alias("table"), F.array(*[F.col(c).cast("string") for c in cols]).alias("cells"))
        out = part if out is None else out.unionByName(part)
    return out


# Days each kind of row is kept.
RETENTION_DAYS = {"routes": 90, "observations": 30, "positions": 14}


def retained(rows: DataFrame, asof: Column, days: int, column: str = "created_at") -> DataFrame:
    return rows.where(F.unix_micros(column) >= F.unix_micros(asof) - days * 86_400_000_000)


def expired_counts(tables: dict[str, tuple[DataFrame, str]], asof: Column) -> DataFrame:
    """How many rows each table would lose."""
    out = None
    for name, (df, column) in tables.items():
        old = F.unix_micros(column) < F.unix_micros(asof) - RETENTION_DAYS[name] * 86_400_000_000
        part = df.agg(F.count_if(old).alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        out = part if out is None else out.unionByName(part)
    return out


class DailyTable:
    """Rows in one folder per UTC day of a time column and, below it, per micro-batch.

    A batch that is repeated overwrites its own folders. Readers that name days
    list and open only those. Rows without the time lie in a folder of their own
    and never expire.
    """

    def __init__(self, spark: SparkSession, path: str, column: str):
        self.spark, self.path, self.column = spark, path.rstrip("/"), column

    def append(self, rows: DataFrame, batch: int) -> DataFrame:
        """Store a batch and return what is stored of it."""
        dated = rows.withColumns({"day": F.to_date(self.column), "batch": F.lit(batch)}).hint("rebalance", "day")
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(self.path)
        stored = self.spark.read.schema(dated.schema).parquet(self.path)
        return stored.where(F.col("batch") == batch).select(*rows.columns)

    def read(self, days: list | None = None, before: int | None = None) -> DataFrame | None:
        """Stored rows, if given only of these days (None stands for rows without a time) and of earlier batches."""
        folders = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/day=*")
        if not folders.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folders):
            return None
        rows = self.spark.read.parquet(self.path).withColumn("day", F.col("day").cast("date"))
        if days is not None:
            rows = rows.where(F.col("day").isin([d for d in days if d is not None]) | (F.col("day").isNull() if None in days else F.lit(False)))
        return rows if before is None else rows.where(F.col("batch") < before)

    def _drop(self, folder: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def purge(self, now: datetime, days: int) -> int:
        """Let rows go whose time lies more than ``days`` before ``now`` (UTC); returns how many.

        Whole days go as folders; only the day in which the limit falls is
        rewritten, batch by batch, so that a repeated call finds the same.
        """
        limit = now - timedelta(days=days)
        rows = self.read()
        if rows is None:
            return 0
        old = F.unix_micros(F.col(self.column).cast("timestamp")) < F.unix_micros(F.lit(limit.isoformat(sep=" ")).cast("timestamp"))
        held = rows.where(F.col("day") <= F.lit(limit.date())).groupBy("day", "batch").agg(F.count_if(old).alias("old"), F.count("*").alias("rows")).collect()
        mixed = [r["batch"] for r in held if 0 < r["old"] < r["rows"]]
        for r in held:
            if r["day"] < limit.date():
                self._drop(f"day={r['day']}")
            elif r["old"] == r["rows"]:
                self._drop(f"day={r['day']}/batch={r['batch']}")
        if mixed:
            kept = cut(rows.where((F.col("day") == F.lit(limit.date())) & F.col("batch").isin(mixed) & ~old))
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(self.path)
        return sum(r["old"] for r in held)
