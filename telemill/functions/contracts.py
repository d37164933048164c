"""What messages and tables hold: names, domains, ranges and schemas."""

from __future__ import annotations


# The wire contract.
SENSORS = ("temperature_c", "vibration_mm_s", "pressure_bar", "power_kw", "rotation_rpm")
RATIOS = {"power_per_rpm": "power_kw", "vibration_per_rpm": "vibration_mm_s"}
CORRELATED = (
    ("power_kw", "rotation_rpm"),
    ("vibration_mm_s", "rotation_rpm"),
    ("temperature_c", "power_kw"),
    ("pressure_bar", "rotation_rpm"),
)
SENSOR_STATISTICS = ("mean", "stddev", "min", "max", "range", "slope_per_second", "deviation_from_mean", "zscore_last")
RATIO_STATISTICS = ("mean", "stddev", "slope_per_second")
RANGES = {"temperature_c": (-50, 300), "vibration_mm_s": (0, 100), "pressure_bar": (0, 50), "power_kw": (0, 500), "rotation_rpm": (0, 6000)}
MACHINE_STATES = ("RUNNING", "IDLE", "STARTING", "MAINTENANCE", "STOPPED", "UNKNOWN")
ANOMALY_TYPES = ("BEARING_WEAR", "OVERHEAT", "PRESSURE_DROP", "POWER_SURGE", "MOTOR_STALL", "SENSOR_STUCK", "SENSOR_DROPOUT", "UNKNOWN")
SEVERITIES = ("MEDIUM", "HIGH", "CRITICAL")
ALERT_STATUSES = ("NEW", "ACKNOWLEDGED", "RESOLVED", "DISMISSED")
SKIP_REASONS = ("MACHINE_NOT_RUNNING", "INSUFFICIENT_SAMPLES", "MISSING_SENSOR_DATA", "MODEL_UNAVAILABLE", "WINDOW_NOT_MATURE")
DLQ_REASONS = ("MALFORMED_JSON", "SCHEMA_VALIDATION_FAILED", "UNSUPPORTED_SCHEMA_VERSION", "UNKNOWN_MACHINE")
LABEL_SOURCES = ("SIMULATOR", "OPERATOR", "MAINTENANCE_LOG")
MACHINE_ID_PATTERN, LINE_ID_PATTERN = "^M-[0-9]{3}$", "^LINE-[A-Z]$"
UUID5_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
#: Name space of alert identifiers.
ALERT_NAMESPACE = "89a66a48-8acb-427e-900e-8e9c63fe7e3e"


def feature_names() -> list[str]:
    """The 52 features in contract order."""
    out = [f"{s}_{k}" for s in SENSORS for k in SENSOR_STATISTICS]
    out += [f"{r}_{k}" for r in RATIOS for k in RATIO_STATISTICS]
    out += [f"corr_{a}__{b}" for a, b in CORRELATED]
    return [*out, "sample_count", "null_ratio"]



READINGS = ", ".join(f"{s}: double" for s in SENSORS)
RAW_DDL = (
    "schema_version string, event_id string, machine_id string, line_id string, event_time string, ingest_time string,"
    f" machine_state string, firmware_version string, readings struct<{READINGS}>"
)
CONTRIBUTORS_DDL = "array<struct<feature: string, z_score: double>>"
MODEL_DDL = "struct<name: string, version: string, trained_at: string, artifact_sha256: string>"
SCORED_DDL = (
    "schema_version string, machine_id string, line_id string, window_start string, window_end string, sample_count long,"
    " running_ratio double, machine_state string, is_scored boolean, skip_reason string, raw_score double, anomaly_score double,"
    f" score_threshold double, is_anomaly boolean, top_contributors {CONTRIBUTORS_DDL}, features map<string, double>, model {MODEL_DDL},"
    " scored_at string, processing_delay_ms long"
)
ALERT_DDL = (
    "schema_version string, alert_id string, machine_id string, line_id string, severity string, status string, anomaly_score double,"
    " score_threshold double, detected_at string, window_start string, window_end string, published_at string,"
    f" consecutive_windows int, top_contributors {CONTRIBUTORS_DDL}, features map<string, double>, model {MODEL_DDL}"
)
