"""What joins send to every task or deal again, on rows made here."""

from pyspark.sql import functions as F

from ballast import session
from ballast.operators import conflicts, joins


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_policies_are_not_gathered_by_the_driver(spark, tmp_path):
    """Two columns of small files hold more rows than the driver should gather."""
    path = str(tmp_path / "policies.parquet")
    spark.range(600_000).select(F.col("id").alias("section_id"), (F.col("id") % 2 == 0).alias("single_track"), F.lit("a rulebook").alias("text")).write.parquet(path)
    w = spark.sql("""select * from values (1, 'a', 5, 'forward', 0, 10), (2, 'b', 6, 'reverse', 0, 9), (3, 'c', 6, 'FORWARD', 5, 12), (4, 'd', null, 'forward', 0, 9),
        (5, 'e', 700000, 'forward', 0, 9), (6, 'f', 700000, 'reverse', 8, 9) t(schedule_id, window_id, section_id, direction, a, b)""")
    w = w.select("*", F.timestamp_seconds("a").alias("entry_at"), F.timestamp_seconds("b").alias("exit_at")).withColumn("section_id", F.col("section_id").cast("bigint"))
    out = conflicts.overlap_conflicts(w, spark.read.parquet(path))
    assert "BroadcastHashJoin" not in physical(out)
    assert {(r.section_id, r.candidate, r.other, r.conflict_type) for r in out.collect()} == {
        (6, 2, 3, "OPPOSING_SINGLE_TRACK"), (6, 3, 2, "OPPOSING_SINGLE_TRACK"),
        (700000, 5, 6, "SAME_SECTION_OVERLAP"), (700000, 6, 5, "SAME_SECTION_OVERLAP")}

def test_manifests_are_dealt_by_record_once(spark, monkeypatch):
    """Sources come first, whatever their number; digests of any text, repeated and missing rows are compared as they are."""
    monkeypatch.setattr(session, "SENT_ROWS", 0, raising=False)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    good, up, text = "0a" * 32, "0A" * 32, "1" * 31
    m = spark.createDataFrame(
        [(1, "a", 1, good, "s", "l"), (2, "b", 1, up, "s", "l"), (3, "c", 1, good + "\n", "s", "l"), (4, "d", 1, text, "s", "l"), (5, "e", 2, good, "s", "l"),
         (6, "f", 1, good, "x", "l"), (7, "g", None, good, "s", "l"), (8, "h", 1, good, "s", None), (9, "i", 1, good, "s", "l"), (10, "j", 1, good, "s", "l"),
         (11, None, 1, good, "s", "l"), (12, "k", 1, None, "s", "l"), (13, "l", 1, good, "s", "l")],
        "case_id int, record_id string, source_id int, expected_digest string, expected_source string, expected_lineage string")
    r = spark.createDataFrame(
        [("a", good, good), ("b", good, good), ("c", good + "\n", good + "\n"), ("d", text, text), ("e", good, good), ("f", good, good), ("g", good, good), ("h", good, good),
         ("i", good, "altered"), ("j", None, good), (None, good, good), ("k", good, good), ("l", good, good), ("l", up, up)], "record_id string, computed_digest string, stored_digest string")
    s = spark.createDataFrame([(1, "s"), (2, None)], "source_id int, source_digest string")
    lines = spark.createDataFrame([(x, "l") for x in "abcdefghijkl"], "record_id string, lineage_digest string")
    try:
        out = joins.invalid_manifest_rows(m, r, s, lines)
        assert physical(out).count("Exchange hashpartitioning(record_id") == 3
        found = sorted((x.case_id, x.code) for x in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found == [(2, "RECORD_DIGEST"), (5, "SOURCE_DIGEST"), (6, "SOURCE_DIGEST"), (7, "SOURCE_DIGEST"), (8, "LINEAGE_DIGEST"), (9, "RECORD_DIGEST"),
                     (10, "RECORD_MISSING"), (11, "RECORD_MISSING"), (12, "RECORD_DIGEST"), (13, "RECORD_DIGEST")]
