"""Column contract shared by every operator.

The fact table is long: one row per component x checkpoint x measurement.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: column names and numbers that results depend on ---------
KEY4 = ["component_id", "batch_id", "component_family", "measurement_name"]
PEER = ["batch_id", "component_family", "measurement_name"]
SCOPE = ["component_family", "measurement_name"]

REQUIRED_COLUMNS = [
    "component_id",
    "batch_id",
    "component_family",
    "hours",
    "measurement_name",
    "measurement_value",
    "upper_limit",
]
OUTCOME_REQUIRED_COLUMNS = [c for c in REQUIRED_COLUMNS if c != "upper_limit"]
REQUIRED_NUMERIC = ["hours", "measurement_value", "upper_limit"]
OPTIONAL_NUMERIC = ["lower_limit", "temperature_c", "humidity_pct", "applied_voltage_v"]
OPTIONAL_TEXT = ["test_condition", "data_source", "measurement_unit", "part_number", "board_position"]

MODEL_FEATURES = [
    "percent_change",
    "delta_fraction_of_limit",
    "slope_fraction_per_hour",
    "acceleration_fraction_per_hour2",
    "variability_fraction_of_limit",
    "limit_fraction",
    "distance_fraction_to_upper_limit",
    "current_batch_robust_z",
    "slope_batch_robust_z",
]
LEVEL_FEATURES = MODEL_FEATURES + ["initial_fraction_of_limit"]
CONDITION_FEATURES = [
    "temperature_c",
    "measurement_temperature_c",
    "voltage_stress_ratio",
    "measurement_voltage_v",
]
AUX_FEATURES = [
    "initial_capacitance_fraction",
    "current_capacitance_fraction",
    "capacitance_change_fraction",
    "initial_dissipation_factor_pct",
    "current_dissipation_factor_pct",
    "dissipation_factor_change_pct",
]
FORECAST_FEATURES = (
    LEVEL_FEATURES
    + CONDITION_FEATURES
    + ["prior_storage_humidity_pct"]
    + AUX_FEATURES
)
HUMIDITY_RANK = "prior_storage_humidity_batch_rank_v2"
CHANNEL_FEATURES = ["channel_peer_median_current_z_v2", "channel_peer_elevated_fraction_v2"]
FEATURE_SETS = {
    "v1_all": FORECAST_FEATURES,
    "leakage_only": LEVEL_FEATURES,
    "leakage_plus_aux": LEVEL_FEATURES + AUX_FEATURES + [HUMIDITY_RANK],
    "leakage_plus_channel_peer": LEVEL_FEATURES + CHANNEL_FEATURES,
}

AS_OF_HOUR = 24.0
TARGET_HOUR = 168.0
CHECKPOINTS = [0.0, 24.0]
HOUR_TOLERANCE = 1e-9
MIN_PEERS = 8
MIN_CHANNEL_PEERS = 5
CHANNEL_Z = 3.0
ROBUST_THRESHOLD = 3.5
GATE_Z = 2.0
STRATA_EDGES = [2.0, 5.0]
MIN_STRATUM = 20
LADDER_HOURS = [6.0, 12.0, 24.0, 48.0, 72.0, 96.0, 120.0, 144.0]
METHODS = ["fixed_limit", "robust_mad", "isolation_forest", "combined", "robust_mad_strict"]
METHOD_LABELS = {
    "fixed_limit": "Fixed upper-limit screening",
    "robust_mad": "Median/MAD robust screening (repository rule)",
    "isolation_forest": "Isolation Forest",
    "combined": "Combined robust + Isolation Forest (existing detector)",
    "robust_mad_strict": "Median/MAD, textbook scale (diagnostic)",
}
METHOD_PARAMETERS = {
    "fixed_limit": ["as_of_hour", "fixed_limit_fraction"],
    "robust_mad": ["as_of_hour", "robust_threshold"],
    "isolation_forest": ["as_of_hour", "contamination", "fit_scope"],
    "combined": ["as_of_hour", "contamination", "robust_threshold", "fit_scope"],
    "robust_mad_strict": ["as_of_hour", "robust_threshold"],
}
ONSET_COLUMNS = ["anomaly_onset_hour", "defect_onset_hour"]
URGENCY = {"ACCEPT": 0, "MONITOR": 1, "RETEST": 2, "ENGINEER_REVIEW": 3}
# --- end of fixed values ----------------------------------------------------


def _fields(strings, doubles):
    return [T.StructField(c, T.StringType()) for c in strings] + [
        T.StructField(c, T.DoubleType()) for c in doubles
    ]


READINGS_SCHEMA = T.StructType(_fields(KEY4, REQUIRED_NUMERIC))

PROFILE_SCHEMA = T.StructType(
    _fields(
        ["profile_id", "component_family", "measurement_name", "measurement_unit", "limit_direction", "status"],
        ["as_of_hour", "target_hour"],
    )
    + [
        T.StructField("required_hours", T.ArrayType(T.DoubleType())),
        T.StructField("min_peer_group_size", T.IntegerType()),
        T.StructField("unit_aliases", T.ArrayType(T.StringType())),
    ]
)

# --- fixed values: screening profiles ---------------------------------------
MICROAMP_ALIASES = ["ua", "µa", "μa", "microamp", "microamps"]
PROFILES = [
    ("digital_ic_leakage_ua", "Digital IC", "leakage_ua", "uA", "upper", "planned",
     24.0, 168.0, [0.0, 24.0], 8, MICROAMP_ALIASES),
    ("power_mosfet_rds_on_mohm", "Power MOSFET", "rds_on_mohm", "mOhm", "upper", "planned",
     24.0, 168.0, [0.0, 24.0], 8, ["mohm", "milliohm", "milliohms", "mω"]),
    ("mlcc_x7r_leakage_ua", "MLCC_X7R", "leakage_ua", "uA", "upper", "supported",
     24.0, 168.0, [0.0, 24.0], 8, MICROAMP_ALIASES),
    ("film_cap_capacitance_nf", "Film Capacitor", "capacitance_nf", "nF", "lower", "planned",
     24.0, 168.0, [0.0, 24.0], 8, ["nf", "nanofarad", "nanofarads"]),
]
# --- end of fixed values ----------------------------------------------------


def profiles(spark, rows=None):
    """The profile dimension: four rows unless the caller brings their own."""
    return spark.createDataFrame(rows or PROFILES, PROFILE_SCHEMA)
