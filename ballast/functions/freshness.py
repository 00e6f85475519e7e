"""Age labels. Every function takes ``asof`` in place of a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ballast.functions.common import seconds_between
from ballast.functions.vocab import (
    DEFAULT_LIMITS,
    FRESHNESS_LIMITS,
    HISTORICAL_TYPES,
    TIMELESS_SOURCES,
)

FUTURE_SECONDS = 300


def _age(asof: Column, observed: Column) -> Column:
    # whole seconds, cut towards zero
    return seconds_between(asof, observed).cast("bigint")


def observation_age(asof: Column, observed: Column) -> Column:
    return F.greatest(F.lit(0), _age(asof, observed))


def observation_freshness(asof: Column, observed: Column, fresh: Column | int, stale: Column | int) -> Column:
    age = observation_age(asof, observed)
    return (
        F.when(observed.isNull(), "UNKNOWN").when(age <= fresh, "FRESH").when(age <= stale, "AGING").otherwise("STALE")
    )


def source_limit(source: Column, which: int) -> Column:
    """Limit 0 fresh, 1 aging or 2 stale of a source, from the fixed table."""
    pick = F.lit(DEFAULT_LIMITS[which])
    for key, limits in FRESHNESS_LIMITS.items():
        if limits != DEFAULT_LIMITS:
            pick = F.when(source == key, limits[which]).otherwise(pick)
    return pick


def evidence_freshness(asof: Column, source: Column, observed: Column) -> Column:
    raw = _age(asof, observed)
    age = F.greatest(F.lit(0), raw)
    return (
        F.when(source.isin(*TIMELESS_SOURCES), "NOT_APPLICABLE")
        .when(observed.isNull() | (raw < -FUTURE_SECONDS), "UNKNOWN")
        .when(age <= source_limit(source, 0), "FRESH")
        .when(age > source_limit(source, 2), "STALE")
        .otherwise("AGING")
    )


def effective_freshness(
    asof: Column, source: Column, observed: Column, valid_until: Column, stored: Column
) -> Column:
    """Expiry first, then the source's policy; a record of no known source keeps its stored label."""
    return (
        F.when(asof > valid_until, "STALE")
        .when(source.isNull(), F.upper(F.coalesce(stored, F.lit("UNKNOWN"))))
        .otherwise(evidence_freshness(asof, source, observed))
    )


def leg_freshness(asof: Column, source_type: Column, observed: Column) -> Column:
    age = seconds_between(asof, observed)
    return (
        F.when(source_type == "UNAVAILABLE", "UNAVAILABLE")
        .when(
            source_type.isin("OPERATOR_INPUT", "SEEDED_BASELINE", "DERIVED", "SIMULATED", "IMPORTED_DOCUMENT"),
            "NOT_APPLICABLE",
        )
        .when(observed.isNull(), "UNAVAILABLE")
        .when(age <= 900, "FRESH")
        .when(age <= 3600, "AGING")
        .otherwise("STALE")
    )


def constraint_currency(
    asof: Column, observed: Column, fetched: Column, valid_until: Column, source_type: Column
) -> Column:
    return (
        F.when(F.upper(source_type).isin(*HISTORICAL_TYPES), "EXPIRED")
        .when((observed > asof) | (fetched > asof), "FUTURE")
        .when(valid_until < asof, "EXPIRED")
        .otherwise("CURRENT")
    )


def position_freshness(asof: Column, observed: Column) -> Column:
    """FRESH to 120 s, AGING to 900 s, then STALE; more than 5 minutes ahead is REJECTED."""
    age = observation_age(asof, observed)
    return (
        F.when(seconds_between(asof, observed) < -FUTURE_SECONDS, "REJECTED").when(age <= 120, "FRESH").when(age <= 900, "AGING").otherwise("STALE")
    )
