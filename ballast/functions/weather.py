"""Weather scores, labels and map conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ballast.functions.common import codes
from ballast.functions.vocab import WEATHER_LABELS

# Advisory texts of a station forecast.
RAIN_ADVISORY = "Heavy monsoon rainfall — speed reduction advised"
WIND_ADVISORY = "Crosswind advisory on high bridges"
FOG_ADVISORY = "Low visibility — fog/dust alert"


def weather_score(codes_col: Column, wind: Column, visibility: Column) -> Column:
    """``struct<score,alerts>``; the score is null unless all three inputs are usable."""
    usable = (
        wind.isNotNull() & ~F.isnan(wind) & (wind >= 0)
        & visibility.isNotNull() & ~F.isnan(visibility) & (visibility >= 0)
        & codes_col.isNotNull() & (F.size(codes_col) > 0) & F.forall(codes_col, lambda c: c >= 0)
    )
    wet = F.exists(codes_col, lambda c: (c >= 200) & (c < 700))
    score = (
        100.0 - F.when(wet, 30.0).otherwise(0.0) - F.when(wind > 15, 20.0).otherwise(0.0)
        - F.when(visibility < 5000, 25.0).otherwise(0.0)
    )
    alerts = codes(
        (~F.coalesce(usable, F.lit(False)), "WEATHER_UNKNOWN"), (usable & wet, "PRECIPITATION"),
        (usable & (wind > 15), "HIGH_WIND"), (usable & (visibility < 5000), "REDUCED_VISIBILITY"),
    )
    return F.struct(F.when(usable, score).alias("score"), alerts.alias("alerts"))


def weather_label(code: Column) -> Column:
    low, high, name = WEATHER_LABELS[0]
    out = F.when(code.between(low, high), name)
    for low, high, name in WEATHER_LABELS[1:]:
        out = out.when(code.between(low, high), name)
    return out.otherwise("cloudy")


def conditions(point_id: Column, code: Column, temp: Column, humidity: Column, wind: Column,
               visibility: Column, uv: Column) -> Column:
    """Array of ``struct<id,type,category,reading>``: the primary condition and threshold ones."""

    def item(kind, category="weather", reading=None):
        kind_col = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(
            F.concat_ws("-", point_id, kind_col).alias("id"), kind_col.alias("type"),
            F.lit(category).alias("category"),
            (F.lit(None).cast("string") if reading is None else reading).alias("reading"),
        )

    whole = lambda x: F.round(x).cast("int").cast("string")
    degrees = F.concat(whole(temp), F.lit("°C"))
    speed = F.concat(whole(wind), F.lit(" km/h"))
    damp = F.concat(whole(humidity), F.lit("%"))
    return F.array_compact(F.array(
        item(weather_label(code), reading=degrees),
        F.when(wind >= 20, item("high_winds", reading=speed)).when(wind >= 10, item("strong_wind", reading=speed)),
        F.when(temp >= 35, item("high_temp", reading=degrees)).when(temp <= 5, item("low_temp", reading=degrees)),
        F.when(humidity >= 85, item("high_humidity", reading=damp))
        .when(humidity <= 30, item("low_humidity", reading=damp)),
        F.when((visibility > 0) & (visibility < 2000),
               item("low_visibility", reading=F.concat(F.format_string("%.1f", visibility / 1000), F.lit(" km")))),
        F.when(uv >= 8, item("high_uv", reading=F.concat(F.lit("UV "), whole(uv)))),
        F.when((temp <= 2) & code.between(51, 67), item("icing")),
        F.when(code >= 95, item("storm_warning", "environmental")),
        F.when((code >= 63) & (humidity > 80), item("flood_risk", "environmental")),
        F.when((visibility > 0) & (visibility < 3000) & (wind > 8) & (humidity < 40), item("dust")),
    ))


def dust_level(pm10: Column) -> Column:
    return F.when(pm10 >= 250, "HAZARD").when(pm10 >= 150, "SEVERE").when(pm10 >= 100, "ADVISORY").otherwise("SAFE")


def dust_index(pm10: Column, dust: Column) -> Column:
    return F.round(F.least(F.lit(100.0), F.greatest(pm10, F.coalesce(dust, F.lit(0.0))) / 3), 1)


def forecast_risk(precipitation: Column, wind: Column, visibility_m: Column) -> Column:
    """``struct<risk,advisory,condition>`` of a station forecast; the first of three causes counts."""
    vis_km = F.round(visibility_m / 1000, 1)
    rain, gale, fog = precipitation > 5, wind > 25, vis_km < 3
    extra = F.when(rain, 35.0).when(gale, 25.0).when(fog, 30.0).otherwise(0.0)
    advisory = F.when(rain, RAIN_ADVISORY).when(gale, WIND_ADVISORY).when(fog, FOG_ADVISORY)
    return F.struct(
        (10 + extra).alias("risk"), advisory.alias("advisory"),
        F.when(precipitation > 2, "Rainy").otherwise("Clear").alias("condition"),
    )


def client_score(code: Column) -> Column:
    """Coarse 0..1 score by code band used by thin clients; unknown codes score 0.7."""
    return (
        F.when(code.between(200, 299), 0.2).when(code.between(500, 599), 0.6)
        .when(code.between(600, 699), 0.5).when(code == 800, 1.0).otherwise(0.7)
    )


def client_status(weather: Column, port: float = 0.65, congestion: float = 0.80, historical: float = 0.70) -> Column:
    final = F.round(weather * 0.40 + 0.30 * port + 0.15 * congestion + 0.15 * historical, 6)
    return F.struct(
        final.alias("score"),
        F.when(final >= 0.65, "APPROVED").when(final >= 0.45, "CAUTION").otherwise("HARD_BLOCKED").alias("status"),
    )
