"""Names, limits and tables that results depend on. Not tunable."""

# Canonical source types of evidence records.
SOURCE_TYPES = (
    "LIVE_PROVIDER", "PUBLIC_OPEN_DATA", "CACHED_PROVIDER", "OPERATOR_INPUT", "SEEDED_BASELINE",
    "DERIVED", "SIMULATED", "OFFLINE_COMPUTED", "IMPORTED_DOCUMENT", "UNAVAILABLE",
)

# Source types that count as real, and those that are only replays, in conflict checks.
REAL_TYPES = (
    "LIVE_PROVIDER", "AUTHORIZED_FEED", "IMPORTED_DOCUMENT", "OPERATOR_INPUT",
    "REAL_HISTORICAL", "REPLAYED_SNAPSHOT",
)
HISTORICAL_TYPES = ("REAL_HISTORICAL", "REPLAYED_SNAPSHOT")

# Source types accepted in case assessments.
CASE_TYPES = (
    "LIVE_PROVIDER", "CACHED_PROVIDER", "OPERATOR_INPUT", "IMPORTED_DOCUMENT",
    "PUBLIC_OPEN_DATA", "DERIVED", "OFFLINE_COMPUTED",
)
PROVIDER_TYPES = ("LIVE_PROVIDER", "CACHED_PROVIDER", "PUBLIC_OPEN_DATA")
COMPUTED_TYPES = ("DERIVED", "OFFLINE_COMPUTED")

# Raw source states and the canonical type each maps to; anything else is DERIVED.
RAW_STATES = {
    "LIVE_PROVIDER": ("LIVE", "LIVE_AIS", "LIVE_FEED"),
    "CACHED_PROVIDER": ("CACHED", "STALE_AIS"),
    "OPERATOR_INPUT": ("OPERATOR_INPUT", "OPERATOR_DECLARED"),
    "SEEDED_BASELINE": ("SEEDED", "SEEDED_BASELINE", "STATIC_ONLY", "DEMO_SCHEDULED"),
    "SIMULATED": ("SIMULATED",),
    "OFFLINE_COMPUTED": ("OFFLINE", "OFFLINE_COMPUTED"),
    "UNAVAILABLE": ("UNAVAILABLE", "NOT_CONFIGURED", "PROVIDER-UNAVAILABLE"),
}

# Freshness limits per source in seconds (fresh, aging, stale).
FRESHNESS_LIMITS = {
    "open_meteo": (900, 1800, 3600),
    "openweather": (900, 1800, 3600),
    "noaa_swpc": (14400, 21600, 32400),
    "railradar": (7200, 10800, 21600),
    "aisstream": (300, 600, 1200),
    "maritime_feed": (900, 1800, 3600),
    "ixigo_partner": (300, 900, 1800),
}
DEFAULT_LIMITS = (900, 1800, 3600)
TIMELESS_SOURCES = (
    "operator_input", "imported_engineering", "demo_engineering", "route_baseline", "derived_engine",
)
LIVE_SOURCES = (
    "open_meteo", "openweather", "noaa_swpc", "railradar", "aisstream", "maritime_feed", "ixigo_partner",
)

# Source types each catalogued source may supply.
LIVE_ALLOWED = ("LIVE_PROVIDER", "CACHED_PROVIDER", "UNAVAILABLE")
OTHER_ALLOWED = {
    "operator_input": ("OPERATOR_INPUT",),
    "demo_engineering": ("SEEDED_BASELINE",),
    "route_baseline": ("SEEDED_BASELINE",),
    "derived_engine": ("DERIVED", "OFFLINE_COMPUTED", "UNAVAILABLE"),
    "imported_engineering": ("IMPORTED_DOCUMENT",),
}

# The five decision roles, the entity and source types each admits, and its score key.
ROLES = ("CLEARANCE_DECISION", "WEATHER", "PORT_ALIGNMENT", "CONGESTION", "HISTORICAL_DELAY")
ROLE_ENTITY = {
    "CLEARANCE_DECISION": "CLEARANCE_RESULT",
    "WEATHER": "WEATHER_SCORE",
    "PORT_ALIGNMENT": "PORT_ALIGNMENT_SCORE",
    "CONGESTION": "CONGESTION_SCORE",
    "HISTORICAL_DELAY": "HISTORICAL_DELAY_SCORE",
}
ROLE_TYPES = {
    "CLEARANCE_DECISION": ("DERIVED",),
    "WEATHER": ("DERIVED",),
    "PORT_ALIGNMENT": ("LIVE_PROVIDER", "CACHED_PROVIDER"),
    "CONGESTION": ("DERIVED",),
    "HISTORICAL_DELAY": ("DERIVED",),
}
ROLE_SCORE = {
    "WEATHER": "weather", "PORT_ALIGNMENT": "port", "CONGESTION": "congestion", "HISTORICAL_DELAY": "historical",
}

# Lineage relations that carry trust in the gate, and in case assessments.
TRUST_RELATIONS = ("INPUT_TO", "DERIVED_FROM", "OVERRIDES", "VALIDATES", "FALLBACK_FOR")
CASE_RELATIONS = ("DERIVED_FROM", "INPUT_TO")

# Key fragments whose values are redacted before hashing.
SENSITIVE_FRAGMENTS = (
    "authorization", "cookie", "jwt", "password", "secret", "service_role", "api_key",
    "access_token", "refresh_token", "database_url", "connection_string",
)
# Record keys redacted on an exact match after snake casing.
SENSITIVE_KEYS = (
    "authorization", "api_key", "apikey", "access_token", "refresh_token", "password",
    "secret", "service_role", "token",
)
# URL query parameters whose values are redacted.
SENSITIVE_PARAMETERS = ("api_key", "api-key", "apikey", "key", "token", "auth", "password", "secret")

# Weights of the route reliability score.
WEIGHTS = {"weather": 0.40, "port": 0.30, "congestion": 0.15, "historical": 0.15}

# Mean delay in minutes to congestion score, joined by straight lines.
DELAY_CURVE = ((0, 100.0), (15, 85.0), (30, 70.0), (60, 40.0), (120, 10.0), (180, 0.0))

# Berth and approach boxes (lat from, lat to, lon from, lon to) and status codes.
BERTH_BOX = (18.93, 18.97, 72.92, 72.99)
APPROACH_BOX = (18.85, 19.05, 72.80, 73.05)
NAV_UNDERWAY, NAV_AT_ANCHOR, NAV_MOORED, NAV_UNDEFINED = 0, 1, 5, 15
PORT_TERMINALS = ("JNPT",)

# Weather code bands (from, to, label), first match wins; anything else is cloudy.
WEATHER_LABELS = (
    (0, 0, "clear"), (1, 1, "partly_cloudy"), (2, 3, "cloudy"), (45, 45, "mist"), (48, 48, "fog"),
    (51, 57, "light_rain"), (61, 62, "light_rain"), (63, 65, "heavy_rain"), (66, 67, "sleet"),
    (71, 77, "snow"), (80, 82, "heavy_rain"), (85, 86, "snow"), (95, 95, "thunderstorm"), (96, 99, "hail"),
)

# Model inputs in order, the target, label classes and columns that would leak the answer.
FEATURES = (
    "route_distance", "segment_count", "departure_hour", "day_of_week", "month",
    "current_delay", "journey_progress", "weather_score", "rainfall", "temperature",
    "wind_speed", "visibility", "corridor_congestion", "station_pressure",
    "historical_delay", "schedule_conflicts", "port_pressure", "loading_window_delta",
    "cargo_weight",
)
TARGET = "remaining_delay_minutes"
REAL_CLASSES = ("REAL_LIVE", "REAL_HISTORICAL")
DATA_CLASSES = REAL_CLASSES + ("OPERATOR_CONFIRMED", "SIMULATED", "SEEDED")
LEAKS = ("final_arrival_delay", "actual_value_when_known", "error_when_known", TARGET)
PROMOTION_GATES = (
    "minimum_real_rows", "minimum_coverage_days", "minimum_corridors",
    "no_synthetic_test_rows", "beats_deterministic_by_10_pct", "no_forbidden_feature_leakage",
)

# Required document kinds of a shipment check and its status precedence.
REQUIRED_DOCUMENTS = ("CARGO_DECLARATION", "INSURANCE", "PERMIT")
CHECK_RANK = {"PASS": 0, "WARNING": 1, "MANUAL_REVIEW": 2, "BLOCKED": 3}
# Decision states from weakest to strictest.
STATE_RANK = {"READY": 0, "HOLD": 1, "UNAVAILABLE": 2, "HARD_BLOCKED": 3}
# Constraint categories a speed advisory cannot do without.
REQUIRED_CONSTRAINTS = ("HEADWAY", "ROUTE_LIMIT")
# How a stored check's status reads on a plan leg; anything else needs review.
LEG_STATUS = {
    "PASS": "PASSED", "PASSED": "PASSED", "WARNING": "WARNING",
    "BLOCKED": "BLOCKED", "MANUAL_REVIEW": "MANUAL_REVIEW",
}

# Column names an open-data timetable may use for each field, in order of preference.
TIMETABLE_ALIASES = {
    "train_code": ("train_code", "train_no", "train_number", "train_num", "train"),
    "train_name": ("train_name", "name", "train_title"),
    "source_station_code": (
        "source_station_code", "from_station_code", "origin_station_code", "source_code", "from_code",
    ),
    "dest_station_code": (
        "dest_station_code", "destination_station_code", "to_station_code", "dest_code", "to_code",
    ),
    "scheduled_departure": ("scheduled_departure", "departure_time", "departure", "dep_time"),
    "scheduled_arrival": ("scheduled_arrival", "arrival_time", "arrival", "arr_time"),
    "service_date": ("service_date", "date", "journey_date", "travel_date"),
}
