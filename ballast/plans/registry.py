"""Named queries over the supplied tables, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, needs: tuple[str, ...] = ()):
    """Register ``fn(tables)`` under ``name``.

    ``needs`` are the derived tables that the check SQL reads; they become the
    leading WITH entries of the SQL.
    """

    def register(fn):
        from ballast.plans.stand_ins import Tables, with_tables

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            # zone-less times of the supplied tables are UTC
            if spark.conf.get("spark.sql.session.timeZone") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            # the JVM never compiles a longer method; Spark then splits it
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
            return fn(Tables(spark, folder))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_tables(needs, oracle)
        return fn

    return register
