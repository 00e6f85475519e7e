"""Reading, writing and freeing of intermediate tables, shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.session import run_folder

#: Words are runs of anything but space and the control characters tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks can import it from anywhere."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    handle, path = tempfile.mkstemp(suffix=".zip", prefix="ballast-")  # the driver serves it to the executors
    with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(package)))
    context.addPyFile(path)
    # whole texts travel: fewer rows at once than Spark's default of 10,000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    _SHIPPED.add(context.applicationId)


class Shelf:
    """Tables written to the shared folder during one operator call.

    A written table cuts the lineage, survives lost executors and has a known
    size. ``drop`` frees a table once its successor is written.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{run_folder(spark)}/{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.held: list[DataFrame] = []  # so that no two tables share an id
        self.count = 0

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def put(self, df: DataFrame, *by: str) -> DataFrame:
        path = self.path()
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.held.append(out)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if id(df) in self.paths:
                self._delete(self.paths.pop(id(df)))

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Id columns as text: pandas would turn numbers beside a null into floats."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def typed_ids(df: DataFrame, like: DataFrame, *columns: str) -> DataFrame:
    """Id columns in the type that they have in ``like``."""
    return df.withColumns({c: F.col(c).cast(like.schema[c].dataType) for c in columns})


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def fold(doc_id: Column, n: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``n``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
