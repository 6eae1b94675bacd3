"""Feature lists, flag maps, schemas and coefficient bounds.

Everything in the section below is a fixed value: results depend on these names and numbers.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------------------

BASIC_FEATURES = [
    "basic_data_clean", "basic_data_unlimited",
    "daily_data_clean", "daily_data_unlimited",
    "voice_clean", "voice_unlimited",
    "message_clean", "message_unlimited",
    "additional_call", "is_5g",
    "tethering_gb", "speed_when_exhausted",
    "data_throttled_after_quota", "data_unlimited_speed", "has_unlimited_speed",
]

FEATURE_SETS = {"basic": BASIC_FEATURES}

# continuous column -> 0/1 column that marks it as unlimited
UNLIMITED_FLAGS = {
    "basic_data_clean": "basic_data_unlimited",
    "daily_data_clean": "daily_data_unlimited",
    "voice_clean": "voice_unlimited",
    "message_clean": "message_unlimited",
    "speed_when_exhausted": "has_unlimited_speed",
}

# features of the explanation tables, with their labels
CORE_CONTINUOUS = {
    "basic_data_clean": "Basic Data",
    "daily_data_clean": "Daily Data",
    "voice_clean": "Voice",
    "message_clean": "SMS",
    "additional_call": "Additional Call",
    "speed_when_exhausted": "Throttled Speed",
    "tethering_gb": "Tethering",
}

FEATURE_UNITS = {
    "basic_data_clean": "GB",
    "daily_data_clean": "GB",
    "voice_clean": "min",
    "message_clean": "SMS",
    "additional_call": "min",
    "speed_when_exhausted": "Mbps",
    "tethering_gb": "GB",
}

USAGE_FEATURES = [
    "basic_data_clean", "daily_data_clean", "voice_clean", "message_clean",
    "tethering_gb", "speed_when_exhausted", "additional_call",
]

DATA_UNLIMITED_VALUES = [999, 9999]
NOT_APPLICABLE = -1
UNLIMITED_DIGITS = "999"
MAX_THROTTLE_MBPS = 10.0

MIXED_COLUMNS = [
    "basic_data", "daily_data", "tethering_gb",
    "mvno_rating", "monthly_review_score", "discount_percentage",
]
FLAG_COLUMNS = [
    "data_sharing", "roaming_support", "micro_payment",
    "is_esim", "signup_minor", "signup_foreigner",
]
KEY_FEATURES = [
    "basic_data_clean", "daily_data_clean", "voice_clean", "message_clean",
    "throttle_speed_normalized", "unlimited_type_numeric", "original_fee",
]

# columns of an already processed file
LOAD_BOOL_COLUMNS = [
    "is_5g", "data_sharing", "roaming_support", "micro_payment", "signup_minor",
    "signup_foreigner", "has_usim", "has_nfc_usim", "usim_is_free", "nfc_usim_is_free",
    "esim_is_free", "usim_supported", "nfc_usim_supported",
]
LOAD_NUMERIC_COLUMNS = [
    "basic_data_clean", "daily_data_clean", "tethering_gb", "voice_clean", "message_clean",
    "additional_call", "agreement_period", "fee", "throttle_speed_normalized",
    "unlimited_type_numeric", "usim_delivery_fee", "nfc_usim_delivery_fee", "esim_fee",
]
LOAD_ZERO_FILL_COLUMNS = [
    "basic_data_clean", "daily_data_clean", "voice_clean", "message_clean", "additional_call",
    "agreement_period", "throttle_speed_normalized", "unlimited_type_numeric", "tethering_gb",
    "usim_delivery_fee", "nfc_usim_delivery_fee", "esim_fee", "usim_is_free",
    "nfc_usim_is_free", "esim_is_free", "usim_supported", "nfc_usim_supported",
    "is_esim_numeric",
]
PROCESSED_MARKER_COLUMNS = ["basic_data_clean", "daily_data_clean", "voice_clean", "message_clean"]

DEFAULT_OPTIONS = {
    "featureSet": "basic", "feeColumn": "fee", "method": "fixed_rates",
    "tolerance": 500, "includeComparison": False,
}

# --- end of fixed values ----------------------------------------------------------------------

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _fields(kind, *names):
    return [T.StructField(n, kind) for n in names]


PLAN_SCHEMA = T.StructType(
    _fields(_L, "id")
    + _fields(_S, "plan_name", "network", "mvno", "mno", "basic_data", "daily_data", "data_exhaustion")
    + _fields(_L, "voice", "message", "additional_call")
    + _fields(_B, "data_sharing", "roaming_support", "micro_payment", "is_esim", "signup_minor",
              "signup_foreigner", "has_usim", "has_nfc_usim")
    + _fields(_S, "tethering_gb", "tethering_status", "tethering_data_unit")
    + _fields(_L, "esim_fee", "usim_delivery_fee", "nfc_usim_delivery_fee")
    + _fields(_S, "esim_fee_status", "usim_delivery_fee_status", "nfc_usim_delivery_fee_status")
    + _fields(_D, "fee", "original_fee", "discount_fee", "post_discount_fee")
    + _fields(_L, "discount_period", "agreement_period")
    + _fields(_B, "agreement")
    + _fields(_S, "agreement_type")
    + _fields(_L, "num_of_signup")
    + _fields(_S, "mvno_rating", "monthly_review_score", "discount_percentage")
)

OPTIONS_SCHEMA = T.StructType([
    T.StructField("featureSet", _S), T.StructField("feeColumn", _S), T.StructField("method", _S),
    T.StructField("tolerance", _D), T.StructField("includeComparison", _B),
])


def feature_set(name: str) -> list[str]:
    try:
        return list(FEATURE_SETS[name])
    except KeyError:
        raise ValueError(f"Unknown feature set: {name}") from None


def continuous(features, flags) -> list[str]:
    """The features that are not themselves unlimited flags."""
    marks = set(flags.values())
    return [f for f in features if f not in marks]


def efficiency_bounds(feature: str) -> tuple[float | None, float | None]:
    """Bounds of the ridge fit on efficient rows: usage >= 0, anything else >= 0.1."""
    return (0.0, None) if feature in USAGE_FEATURES else (0.1, None)


def whole_table_bounds(feature: str) -> tuple[float | None, float | None]:
    """Bounds of the regressions through the origin."""
    if feature in USAGE_FEATURES:
        return 0.1, None
    if feature == "is_5g":
        return 100.0, None
    if "unlimited" in feature or "throttled" in feature:
        return 100.0, 20000.0
    return 0.0, None


def redistribution_bounds(feature: str) -> tuple[float, float | None]:
    if "unlimited" in feature or feature == "is_5g":
        return 100.0, 20000.0
    return 0.1, None


def economic_bounds(feature: str) -> tuple[float, float | None]:
    name = feature.lower()
    if "unlimited" in name:
        return 100.0, 20000.0
    if "5g" in name or "tethering" in name:
        return 100.0, 10000.0
    return 0.1, None
