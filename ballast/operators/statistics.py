"""Comparison of decision rules, model error measures and profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ballast.functions.vocab import DATA_CLASSES, FEATURES, LEAKS, PROMOTION_GATES, REAL_CLASSES, TARGET
from ballast.operators.ordered import percentiles

# Fixed value: normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054


def confusion(cases: DataFrame, classifiers: list[str], truth: str) -> DataFrame:
    """tp, tn, fp and fn per classifier from one pass over the cases."""
    yes = F.col(truth)
    cells = []
    for c in classifiers:
        said = F.col(c)
        cells += [
            F.count_if(yes & said).alias(f"{c}__tp"), F.count_if(~yes & ~said).alias(f"{c}__tn"),
            F.count_if(~yes & said).alias(f"{c}__fp"), F.count_if(yes & ~said).alias(f"{c}__fn"),
        ]
    row = cases.agg(*cells)
    each = [
        F.struct(F.lit(c).alias("classifier"), *[F.col(f"{c}__{k}").alias(k) for k in ("tp", "tn", "fp", "fn")])
        for c in classifiers
    ]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def wilson(successes: Column, trials: Column, z: float = Z95) -> Column:
    """``struct<low,high>`` to six places; [0, 0] without trials."""
    p = successes / trials
    bottom = 1 + z * z / trials
    centre = (p + z * z / (trials * 2)) / bottom
    half = z * F.sqrt(p * (1 - p) / trials + z * z / (4.0 * trials * trials)) / bottom
    none = trials <= 0
    return F.struct(
        F.when(none, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), centre - half), 6)).alias("low"),
        F.when(none, 0.0).otherwise(F.round(F.least(F.lit(1.0), centre + half), 6)).alias("high"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def classifier_metrics(confusions: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(k).cast("double") for k in ("tp", "tn", "fp", "fn"))
    bottom = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return confusions.select(
        "*",
        F.round(_share(fp, tn + fp), 6).alias("false_admission_rate"),
        F.round(_share(fn, tp + fn), 6).alias("false_hold_rate"),
        F.round((_share(tp, tp + fn) + _share(tn, tn + fp)) / 2, 6).alias("balanced_accuracy"),
        F.round(F.when(bottom > 0, (tp * tn - fp * fn) / bottom).otherwise(0.0), 6).alias("matthews"),
    )


def paired_disagreements(cases: DataFrame, pairs: list[tuple[str, str]], truth: str) -> DataFrame:
    """Cases only the left or only the right rule gets right, per pair, in one pass."""
    right = {c: F.col(c) == F.col(truth) for pair in pairs for c in pair}
    cells = []
    for i, (a, b) in enumerate(pairs):
        cells += [
            F.count_if(right[a] & ~right[b]).alias(f"l{i}"), F.count_if(right[b] & ~right[a]).alias(f"r{i}"),
        ]
    each = [
        F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(f"l{i}").alias("left_only"), F.col(f"r{i}").alias("right_only"))
        for i, (a, b) in enumerate(pairs)
    ]
    return cases.agg(*cells).select(F.explode(F.array(*each)).alias("x")).select("x.*")


def _log_choose_half(n: Column, k: Column) -> Column:
    """Natural log of C(n, k) / 2**n, accurate for large n.

    Below 40 the product is summed term by term; above, Stirling's series is used
    with the leading parts combined so that they do not cancel.
    """
    k = k.cast("double")
    n = n.cast("double")
    small = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(k, F.lit(40.0)).cast("int"))), F.lit(0.0),
        lambda acc, i: acc + F.when(i <= k, F.log((n - k + i) / i)).otherwise(0.0),
    ) - n * math.log(2)
    x = (n - 2 * k) / n
    spread = (1 + x) * F.log1p(x) / 2 + (1 - x) * F.log1p(-x) / 2
    tail = lambda m: 1 / (12 * m) - 1 / (360 * m * m * m) + 1 / (1260 * m * m * m * m * m)
    large = -n * spread - F.log(2 * math.pi * k * (n - k) / n) / 2 + tail(n) - tail(k) - tail(n - k)
    return F.when(k < 40, small).otherwise(large)


def exact_mcnemar(pairs: DataFrame) -> DataFrame:
    """Two-sided exact binomial p of each pair of disagreement counts.

    The lower tail is summed downwards from its largest term. Terms further than
    seven square roots of n below it are smaller than 1e-40 of it, so the sum is
    exact to double precision while its length grows only with that root.
    """
    l, r = F.col("left_only"), F.col("right_only")
    n, tail = (l + r), F.least(l, r)
    steps = F.least(tail, F.ceil(7 * F.sqrt(n)) + 60).cast("bigint")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, i):
        term = acc["term"] * (tail - i + 1) / (n - tail + i)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    ratio = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(steps, F.lit(1))), start, step)["total"]).otherwise(1.0)
    log10p = (_log_choose_half(n, tail) + F.log(2 * ratio)) / math.log(10)
    capped = F.when(n == 0, 0.0).otherwise(F.least(F.lit(0.0), log10p))
    return pairs.select(
        "pair", "left_only", "right_only", n.alias("discordant"),
        F.round(F.when(capped > -324, F.pow(F.lit(10.0), capped)).otherwise(0.0), 12).alias("p"),
        F.round(capped, 6).alias("log10_p"),
    )


def holm(comparisons: DataFrame, name: str = "pair", p: str = "p") -> DataFrame:
    """Step-down adjusted p of a family of comparisons (one row per pair of rules, so a short list)."""
    order = Window.orderBy(p, name)
    m = F.count("*").over(Window.partitionBy())
    raw = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    return comparisons.withColumn("_raw", raw).withColumn(
        "adjusted_p", F.round(F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0)), 12)
    ).drop("_raw")


def fault_summary(cases: DataFrame, classifiers: list[str]) -> DataFrame:
    return cases.groupBy("fault_type").agg(
        F.count("*").alias("cases"), *[F.count_if(c).alias(f"{c}_admitted") for c in classifiers]
    )


def reason_counts(cases: DataFrame, keys: list[str], column: str = "reason_codes") -> DataFrame:
    code = F.explode(F.split(column, r"\|")).alias("code")
    return cases.select(*keys, code).where("code <> ''").groupBy(*keys, "code").agg(F.count("*").alias("n"))


# --- model data and errors -----------------------------------------------------------


def dataset_violations(rows: DataFrame) -> DataFrame:
    """Contract breaches of training rows as (code, n); no rows means the set is usable.

    A missing or leaking column is reported from the schema, everything else from one pass.
    """
    spark = rows.sparkSession
    present = set(rows.columns)
    wanted = ["observation_time", "data_class", *FEATURES, TARGET]
    fixed = [(f"MISSING_COLUMN:{c}", 1) for c in wanted if c not in present]
    fixed += [(f"LEAKING_FEATURE:{c}", 1) for c in FEATURES if c in LEAKS]
    numbers = [c for c in (*FEATURES, TARGET) if c in present]
    tests = {}
    for c in numbers:
        v = F.col(c).try_cast("double")
        tests[f"MISSING_VALUE:{c}"] = F.col(c).isNull()
        tests[f"NOT_NUMERIC:{c}"] = F.col(c).isNotNull() & v.isNull()
        tests[f"NOT_FINITE:{c}"] = v.isNotNull() & (F.isnan(v) | (F.abs(v) == float("inf")))
    if "data_class" in present:
        tests["UNKNOWN_CLASS"] = ~F.coalesce(F.col("data_class").isin(*DATA_CLASSES), F.lit(False))
    if "observation_time" in present:
        tests["BAD_TIME"] = F.col("observation_time").try_cast("timestamp").isNull()
    names = list(tests)
    sums = rows.agg(
        F.when(F.count("*") == 0, 1).otherwise(0).cast("bigint").alias("_empty"),
        *[F.count_if(tests[n]).alias(f"_{i}") for i, n in enumerate(names)],
    )
    each = [F.struct(F.lit("EMPTY").alias("code"), F.col("_empty").alias("n"))]
    each += [F.struct(F.lit(n).alias("code"), F.col(f"_{i}").alias("n")) for i, n in enumerate(names)]
    found = sums.select(F.explode(F.array(*each)).alias("x")).select("x.*").where("n > 0")
    if fixed:
        found = found.unionByName(spark.createDataFrame(fixed, "code string, n bigint"))
    return found


def dataset_report(rows: DataFrame) -> DataFrame:
    """One row: sizes by class, time span, distinct routes and corridors, target distribution."""
    cls = F.col("data_class")
    span = (F.unix_micros(F.max("observation_time")) - F.unix_micros(F.min("observation_time"))) / 86_400e6
    base = rows.agg(
        F.count("*").alias("row_count"), F.count_if(cls.isin(*REAL_CLASSES)).alias("real_row_count"),
        F.count_if(cls == "SIMULATED").alias("simulated_row_count"), F.count_if(cls == "SEEDED").alias("seeded_row_count"),
        F.count_if(cls == "OPERATOR_CONFIRMED").alias("operator_confirmed_row_count"),
        F.min("observation_time").alias("start_time"), F.max("observation_time").alias("end_time"),
        F.greatest(F.lit(1), F.ceil(span)).cast("int").alias("coverage_days"),
        F.count_distinct("route_id").alias("routes_count"), F.count_distinct("corridor").alias("corridors_count"),
        F.min(TARGET).alias("target_min"), F.avg(TARGET).alias("target_mean"), F.max(TARGET).alias("target_max"),
    )
    return base.crossJoin(F.broadcast(percentiles(rows, [], TARGET, {"target_median": 0.5})))


def missing_values(rows: DataFrame) -> DataFrame:
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns])
    each = [F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in rows.columns]
    return counts.select(F.explode(F.array(*each)).alias("x")).select("x.*").where("n > 0")


def metric_set(rows: DataFrame, keys: list[str], truth: str, guess: str) -> DataFrame:
    """MAE, RMSE, median absolute error and R² per group."""
    y, e = F.col(truth), F.col(truth) - F.col(guess)
    errors = rows.withColumn("_abs", F.abs(e))
    base = errors.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.round(F.avg("_abs"), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"),
        F.round(1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0)), 5).alias("r2"),
    )
    med = percentiles(errors, keys, "_abs", {"median_ae": 0.5})
    joined = base.join(med, keys) if keys else base.crossJoin(F.broadcast(med))
    return joined.withColumn("median_ae", F.round("median_ae", 4))


def residual_p90(rows: DataFrame, keys: list[str], truth: str, guess: str) -> DataFrame:
    """Held-out error quantile; trusted only with 30 rows that are all real."""
    errors = rows.withColumn("_abs", F.abs(F.col(truth) - F.col(guess)))
    base = errors.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.bool_and(F.col("data_class").isin(*REAL_CLASSES)).alias("_real")
    )
    p90 = percentiles(errors, keys, "_abs", {"p90": 0.9})
    joined = base.join(p90, keys) if keys else base.crossJoin(F.broadcast(p90))
    return joined.select(
        *keys, "rows", F.round("p90", 4).alias("p90"), ((F.col("rows") >= 30) & F.col("_real")).alias("trusted")
    )


def feature_bounds(rows: DataFrame, features=FEATURES) -> DataFrame:
    """One row per feature with its smallest and largest value."""
    row = rows.agg(*[F.min(c).alias(f"{c}__lo") for c in features], *[F.max(c).alias(f"{c}__hi") for c in features])
    each = [
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__lo").alias("low"), F.col(f"{c}__hi").alias("high"))
        for c in features
    ]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def promotion_gates(report: DataFrame, improvement_pct: Column, test_all_real: Column) -> DataFrame:
    """The six named gates of a candidate model and whether all hold."""
    gates = {
        "minimum_real_rows": F.col("real_row_count") >= 1000,
        "minimum_coverage_days": F.col("coverage_days") >= 14,
        "minimum_corridors": F.col("corridors_count") >= 3,
        "no_synthetic_test_rows": test_all_real,
        "beats_deterministic_by_10_pct": improvement_pct >= 10,
        "no_forbidden_feature_leakage": F.lit(not set(FEATURES) & set(LEAKS)),
    }
    out = report.select(*[g.alias(n) for n, g in gates.items()])
    every = F.lit(True)
    for n in PROMOTION_GATES:
        every = every & F.col(n)
    return out.withColumn("eligible", every)


def missing_gates(gates: Column) -> Column:
    """Required gates absent from a map, and those present but not true."""
    absent = F.transform(F.array_except(F.array(*map(F.lit, PROMOTION_GATES)), F.map_keys(gates)),
                         lambda g: F.concat(F.lit("missing:"), g))
    failed = F.map_keys(F.map_filter(gates, lambda k, v: ~F.coalesce(v, F.lit(False))))
    return F.array_sort(F.concat(absent, failed))


def drift_report(predictions: DataFrame, keys: list[str], ml_mae: float | None, formula_mae: float | None,
                 minimum: int = 20) -> DataFrame:
    """Observed error against the reference error of the mode that served each row."""
    labeled = predictions.where("actual_value is not null")
    signed = F.col("predicted_value") - F.col("actual_value")
    fallback = F.abs(F.col("predicted_value") - F.col("deterministic_value")) < 1e-9
    usable = lambda x: F.lit(float(x) if x and x > 0 else None).cast("double")
    ref = F.when(fallback, usable(formula_mae)).otherwise(usable(ml_mae))
    per = labeled.withColumns({"_e": signed, "_r": ref, "_f": fallback}).groupBy(*keys).agg(
        F.count("*").alias("labels"), F.count("_r").alias("_refs"),
        F.avg(F.abs("_e")).alias("_mae"), F.avg("_e").alias("_bias"), F.avg("_r").alias("_ref"),
        F.count_if("_f").alias("fallback_rows"), F.count_if(~F.col("_f")).alias("ml_rows"),
        F.min("predicted_at").alias("window_start"), F.max("predicted_at").alias("window_end"),
    )
    enough = (F.col("labels") >= minimum) & (F.col("_refs") == F.col("labels"))
    ratio = F.col("_mae") / F.col("_ref")
    shown = lambda c: F.when(enough, F.round(c, 4))
    return per.select(
        *keys, "labels", "fallback_rows", "ml_rows",
        F.when(~enough, "INSUFFICIENT_DATA").when(ratio > 1.5, "DRIFT_DETECTED").when(ratio > 1.2, "WATCH")
        .otherwise("STABLE").alias("status"),
        shown(F.col("_mae")).alias("observed_mae"), shown(F.col("_bias")).alias("observed_bias"),
        shown(F.col("_ref")).alias("reference_mae"), shown(ratio).alias("mae_ratio"), "window_start", "window_end",
    )


def retraining_readiness(predictions: DataFrame, drift: DataFrame, keys: list[str]) -> DataFrame:
    """Five gates on labels, coverage, routes, label origin and drift, and the resulting status."""
    labeled = predictions.where("actual_value is not null")
    days = F.floor((F.unix_micros(F.max("predicted_at")) - F.unix_micros(F.min("predicted_at"))) / 86_400e6) + 1
    per = labeled.groupBy(*keys).agg(
        (F.count("*") >= 100).alias("enough_labels"), (F.greatest(F.lit(1), days) >= 14).alias("enough_days"),
        (F.count_distinct("route_id") >= 3).alias("enough_routes"),
        F.bool_and(F.coalesce("outcome_class", F.lit("UNCLASSIFIED")) == "OPERATOR_CONFIRMED").alias("trusted_labels"),
    )
    j = drift.select(*keys, "labels", F.col("status").alias("drift_status")).join(per, keys, "left")
    needs = F.col("drift_status").isin("WATCH", "DRIFT_DETECTED")
    gate = lambda c: F.coalesce(c, F.lit(False))
    every = gate(F.col("enough_labels") & F.col("enough_days") & F.col("enough_routes") & F.col("trusted_labels") & needs)
    return j.select(
        *keys, *[gate(F.col(c)).alias(c) for c in ("enough_labels", "enough_days", "enough_routes", "trusted_labels")],
        needs.alias("drift_needs_attention"),
        F.when(every, "READY_FOR_MANUAL_REVIEW")
        .when((F.col("drift_status") == "STABLE") & (F.col("labels") >= 20), "NOT_NEEDED")
        .otherwise("NOT_READY").alias("status"),
    )


# --- trial summaries --------------------------------------------------------------------


def provider_summary(attempts: DataFrame) -> DataFrame:
    """Requests, successes, availability, mean and nearest-rank p95 latency per provider."""
    base = attempts.groupBy("provider").agg(
        F.count("*").alias("requests"), F.count_if(F.col("http_status") == 200).alias("http_200"),
        F.count_if("schema_valid").alias("valid"), F.round(F.avg("latency_ms"), 3).alias("mean_ms"),
    )
    p95 = percentiles(attempts, ["provider"], "latency_ms", {"p95_ms": 0.95}, method="nearest")
    return base.join(p95, "provider").withColumns({
        "availability_pct": F.round(F.col("valid") * 100 / F.col("requests"), 2), "p95_ms": F.round("p95_ms", 3),
    })


def scenario_summary(trials: DataFrame) -> DataFrame:
    base = trials.groupBy("scenario").agg(
        F.count("*").alias("trials"), F.count_if("passed").alias("passed"), F.round(F.avg("elapsed_ms"), 6).alias("mean_ms"),
    )
    mid = percentiles(trials, ["scenario"], "elapsed_ms", {"median_ms": 0.5})
    top = percentiles(trials, ["scenario"], "elapsed_ms", {"p95_ms": 0.95}, method="nearest")
    return base.join(mid, "scenario").join(top, "scenario").select(
        "scenario", "trials", "passed", F.round(F.col("passed") * 100 / F.col("trials"), 2).alias("pass_rate_pct"),
        "mean_ms", F.round("median_ms", 6).alias("median_ms"), F.round("p95_ms", 6).alias("p95_ms"),
    )


def state_counts(trials: DataFrame) -> DataFrame:
    return trials.groupBy("scenario", "actual_state").agg(F.count("*").alias("n"))
