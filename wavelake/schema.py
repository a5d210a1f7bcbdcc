"""Tables and constants of the signal side of the engine.

A recording is rows of ``samples``: one row for each sample of each channel.  Channel is a grouping key, not a column, so the
schema does not depend on the number of channels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SAMPLES = "recording_id string, sample_idx long, t_sec double, channel_idx int, channel string, value double"
EVENTS = "recording_id string, event_id string, t_sec double, value int"
RECORDINGS = (
    "recording_id string, path string, format string, board string, fs int, n_channels int, n_samples long, duration_sec double, "
    "has_accelerometer boolean, has_markers boolean, channels array<string>"
)
SUBJECTS = "id long, code string, age int, gender string, created_at string"
EXPERIMENTS = "id long, subject_id long, condition string, date string, notes string, created_at string"
#: Columns added to the catalog later, with their defaults.
EXPERIMENT_ADDITIONS = {"eeg_path": ("string", None), "source": ("string", "upload"), "analysis_status": ("string", "pending")}
FEATURES = ["theta_alpha_ratio", "alpha_rel", "beta_rel", "gamma_rel", "eeg_entropy", "cog_load"]

# Fixed values that results depend on.
BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 45.0)}
#: Loss indicators rise when flow breaks, flow indicators fall.
FLOW_INDICATORS = ["theta_alpha_ratio", "alpha_rel", "beta_rel"]
LOSS_INDICATORS = ["gamma_rel", "eeg_entropy", "cog_load"]
#: Condition: (disruption, seed).
CONDITIONS = {"AtoA": (0.0, 42), "AtoB": (1.0, 100), "AtoC": (1.6, 200), "BtoC": (1.3, 300)}
DEFAULT_EVENTS = [
    ("S0", 0.0), ("B0", 5.0), ("B1", 65.0), ("F0", 65.0), ("F1", 305.0), ("F2", 545.0),
    ("X0", 545.0), ("X1", 665.0), ("R0", 665.0), ("R1", 1265.0), ("Q0", 1265.0),
]
#: Preset: (high-pass, low-pass, notch) in Hz.
FILTER_PRESETS = {"eeg": (1.0, 45.0, 50.0), "emg": (20.0, 250.0, 50.0), "ecg": (0.5, 40.0, 50.0)}
#: Number of columns of a board file: (board, signal channels, rate).
BOARD_COLUMNS = {24: ("cyton", 8, 250), 28: ("daisy", 16, 125), 18: ("ganglion", 4, 200), 15: ("ganglion", 4, 200), 22: ("cyton", 8, 250), 30: ("daisy", 16, 125)}
#: Component: (window in seconds after the event, polarity).
COMPONENTS = {
    "P50": (0.04, 0.08, "positive"),
    "N100": (0.08, 0.14, "negative"),
    "N170": (0.14, 0.20, "negative"),
    "P200": (0.15, 0.25, "positive"),
    "N200": (0.20, 0.35, "negative"),
    "P3a": (0.25, 0.40, "positive"),
    "P300": (0.30, 0.60, "positive"),
    "P3b": (0.35, 0.65, "positive"),
    "N400": (0.35, 0.55, "negative"),
}
TINY = 1e-12


def bands(spark: SparkSession) -> DataFrame:
    """(band, lo, hi): five rows."""
    return spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in BANDS.items()], "band string, lo double, hi double")


def default_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_EVENTS, "event_id string, t_sec double")
