"""Recorded bytes, map ways and engineering limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.functions.common import blank_to_null, codes, finite
from ballast.functions.digest import digest_of
from ballast.operators.contracts import certification_codes

MAX_FEEDS = 16


def recorded_files(spark: SparkSession, folder: str) -> DataFrame:
    """Name, length and SHA-256 of each file of a recorded snapshot. Spark skips empty files, so these count as not there."""
    f = spark.read.format("binaryFile").load(folder)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("local_filename"), F.col("length").alias("actual_length"), F.sha2("content", 256).alias("actual_digest"))


def snapshot_check(manifests: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Each manifest feed against the recorded bytes; a file that is not there is invalid.

    ``manifests``: keys, feeds array<struct<source_key,local_filename,byte_length,sha256>>
    and operational_authority; ``files``: keys, local_filename, length and digest.
    """
    m = manifests.withColumn("_n", F.size("feeds")).select(*keys, "operational_authority", "_n", F.explode("feeds").alias("f"))
    rows = m.select(*keys, "operational_authority", "_n", "f.*")
    j = rows.join(files, [*keys, "local_filename"], "left")
    same = F.coalesce((F.col("byte_length") == F.col("actual_length")) & (F.col("sha256") == F.col("actual_digest")), F.lit(False))
    safe = F.col("local_filename").rlike(r"^[^/\\]+$") & ~F.col("local_filename").isin(".", "..")
    twice = rows.groupBy(*keys, "local_filename").agg(F.count("*").alias("_k"))
    return j.join(twice, [*keys, "local_filename"]).select(
        *keys, "source_key", "local_filename", same.alias("checksum_valid"),
        F.array_join(codes(
            (~safe, "UNSAFE_NAME"), (F.col("_k") > 1, "REPEATED_NAME"), (~F.col("_n").between(1, MAX_FEEDS), "FEED_COUNT"),
            (~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "DIGEST_FORM"),
            (~F.coalesce(F.col("operational_authority") == "NONE", F.lit(False)), "AUTHORITY_CLAIMED"),
        ), ",").alias("codes"),
    )


MANIFEST = "struct<operational_authority:string,feeds:array<struct<source_key:string,local_filename:string,byte_length:bigint,sha256:string>>>"


def inspect_recorded(spark: SparkSession, folder: str, manifest: str, pinned_digest: str) -> DataFrame:
    """The recorded snapshot in ``folder`` against its manifest: one row per feed, as ``snapshot_check`` gives them.

    ``manifest`` is the file of the folder that lists the feeds; ``manifest_valid``
    tells whether its bytes have the digest that was pinned beforehand. No feed of
    another manifest counts as valid. A folder without the manifest, or one that
    lists nothing, gives one row with the code of that.
    """
    stored = recorded_files(spark, folder)
    text = spark.read.format("binaryFile").load(folder).where(F.element_at(F.split("path", "/"), -1) == manifest)
    found = text.select(F.from_json(F.decode("content", "UTF-8"), MANIFEST).alias("m"), F.sha2("content", 256).eqNullSafe(pinned_digest.lower()).alias("manifest_valid"))
    head = spark.range(1).join(found, how="left").select(
        F.lit(0).alias("_one"), F.coalesce("manifest_valid", F.lit(False)).alias("manifest_valid"), F.col("m.operational_authority").alias("operational_authority"),
        F.coalesce("m.feeds", F.array().cast("array<struct<source_key:string,local_filename:string,byte_length:bigint,sha256:string>>")).alias("feeds"), F.col("m").isNull().alias("_lost"))
    feeds = snapshot_check(head.select("_one", "operational_authority", "feeds"), stored.withColumn("_one", F.lit(0)), ["_one"])
    none = F.lit(None).cast("string")
    out = head.join(feeds, "_one", "left")
    code = F.when(F.col("_lost"), "MANIFEST_MISSING").when(F.size("feeds") == 0, "FEED_COUNT").otherwise(F.col("codes"))
    sound = F.col("manifest_valid") & F.coalesce(F.col("checksum_valid"), F.lit(False)) & (F.coalesce("codes", none) == "")
    return out.select("manifest_valid", "source_key", "local_filename", F.coalesce(sound, F.lit(False)).alias("checksum_valid"), code.alias("codes"))


def way_tracks(elements: DataFrame) -> DataFrame:
    """Points of each map way in order; unknown nodes are dropped, ways of fewer than two points too.

    ``elements``: type, id, lat, lon, nodes array<bigint>. One row per track point.
    """
    nodes = elements.where("type = 'node'").select(F.col("id").alias("node_id"), "lat", "lon")
    steps = elements.where("type = 'way'").select(F.col("id").alias("way_id"), F.posexplode("nodes").alias("pos", "node_id"))
    pts = steps.join(nodes, "node_id")
    long = pts.groupBy("way_id").agg(F.count("*").alias("n")).where("n >= 2").select("way_id")
    return pts.join(long, "way_id", "left_semi").select("way_id", "pos", "lat", "lon")


LIMITS = ("max_height", "max_width", "max_weight", "congestion_factor", "historical_delay_hours")
# Source types an engineering load may have.
TRUSTED_LOADS = ("OPERATOR_INPUT", "IMPORTED_DOCUMENT")


def engineering_rows(rows: DataFrame, asof: Column, issuers: list[str], trusted: tuple[str, ...] = TRUSTED_LOADS) -> DataFrame:
    """Text rows of a limits file, typed, with the codes that refuse each."""
    upper = lambda c: F.upper(F.trim(c))
    geom = F.from_json("geometry_lon_lat", "array<array<double>>")
    line = F.transform(geom, lambda p: F.struct(F.round(F.get(p, 0), 7).alias("lon"), F.round(F.get(p, 1), 7).alias("lat")))
    t = rows.withColumns({
        "source_code": upper("source_code"), "destination_code": upper("destination_code"), "source_type": upper("source_type"),
        "line": line, **{c: F.trim(c).try_cast("double") for c in LIMITS},
    })
    positive = lambda c: F.coalesce((F.col(c) > 0) & finite(F.col(c)), F.lit(False))
    whole = F.forall("line", lambda p: F.coalesce(finite(p["lon"]) & finite(p["lat"]), F.lit(False)))
    return t.withColumn("codes", F.concat(codes(
        (~F.coalesce(F.col("source_type").isin(*trusted), F.lit(False)), "UNTRUSTED_SOURCE_TYPE"),
        (F.coalesce(F.size("line"), F.lit(0)) < 2, "TOO_FEW_POINTS"), (~whole, "POINT_INVALID"),
        (~(positive("max_height") & positive("max_width") & positive("max_weight")), "LIMIT_NOT_POSITIVE"),
        (~(finite(F.col("congestion_factor")) & finite(F.col("historical_delay_hours"))), "NUMBER_INVALID"),
        (blank_to_null(F.col("source_reference")).isNull() | blank_to_null(F.col("certified_by")).isNull(), "CERTIFICATION_MISSING"),
    ), certification_codes(asof, issuers)))


def load_engineering(segments: DataFrame, rows: DataFrame, asof: Column, issuers: list[str]) -> tuple[DataFrame, DataFrame]:
    """The segments after a load of certified limits, and the load's violations (segment, code).

    All or nothing: with any violation, or without rows, the segments are the old
    ones and ``engineering_digest`` is null throughout. Otherwise the loaded ones
    carry the new limits and the digest that seals them.
    """
    typed = engineering_rows(rows, asof, issuers)
    key = ["source_code", "destination_code"]
    known = segments.select(F.col("src_code").alias("source_code"), F.col("dst_code").alias("destination_code")).distinct()
    name = F.concat_ws("->", *key).alias("segment")
    own = typed.select(name, F.explode("codes").alias("code"))
    twice = typed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(name, F.lit("DUPLICATE_SEGMENT").alias("code"))
    stray = typed.join(known, key, "left_anti").select(name, F.lit("UNKNOWN_SEGMENT").alias("code")).distinct()
    empty = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("").alias("segment"), F.lit("NO_ROWS").alias("code"))
    bad = own.unionByName(twice).unionByName(stray).unionByName(empty)

    # keys are unique wherever the load is applied; grouping keeps a refused load from multiplying segments
    one = typed.groupBy(*key).agg(F.min(F.struct(*LIMITS, "line", "source_type", "source_reference", "certified_by", "certified_at")).alias("r")).select(*key, "r.*")
    sealed = one.withColumn("engineering_digest", digest_of(one, one.columns))
    new = sealed.select(
        F.col("source_code").alias("src_code"), F.col("destination_code").alias("dst_code"), F.col("max_height").alias("n_h"), F.col("max_width").alias("n_w"),
        F.col("max_weight").alias("n_t"), F.col("congestion_factor").alias("n_f"), F.col("historical_delay_hours").alias("n_d"), F.col("engineering_digest").alias("n_s"))
    verdict = bad.agg((F.count("*") == 0).alias("applied"))  # one row
    pairs = {"max_h": "n_h", "max_w": "n_w", "max_t": "n_t", "factor": "n_f", "delay_h": "n_d"}
    out = segments.join(new, ["src_code", "dst_code"], "left").crossJoin(F.broadcast(verdict))
    out = out.withColumns({k: F.when(F.col("applied") & F.col("n_s").isNotNull(), F.col(v)).otherwise(F.col(k)) for k, v in pairs.items()})
    return out.withColumn("engineering_digest", F.when(F.col("applied"), F.col("n_s"))).drop(*pairs.values(), "n_s", "applied"), bad
