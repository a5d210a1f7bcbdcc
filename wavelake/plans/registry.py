"""Named queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import base, files, groups, kernels_queries, signals  # noqa: F401


#: Columns whose type the SQL text leaves to the other engine, by query.
TYPES = {
    **{n: {"label": "BIGINT"} for n in ("j10_paired_by_position", "a26_paired_t", "a27_signed_rank", "a29_pearson")},
    **{n: {"freq": "DOUBLE"} for n in ("a01_mean_density", "a01_density_fft", "p03_bands_of_bins")},
    **{n: {"channel_idx": "BIGINT"} for n in ("j04_epochs", "a13_average")},
    "a02_band_table": {"peak_freq": "DOUBLE", "edge_freq": "DOUBLE"},
    "a05_spectrogram": {"t_sec": "DOUBLE", "freq": "DOUBLE"},
    "a23_overall_recovery": {"recovery_time": "DOUBLE"},
    "a34_profile": {"flat": "DOUBLE"},
    "p09_normalised": {"t_sec": "DOUBLE"},
    "s01_file_formats": {"id": "BIGINT"},
    "s05_header_settings": {"fs": "BIGINT", "n_channels": "BIGINT"},
    "s06_header_exports": {"channel_idx": "BIGINT", "t_sec": "DOUBLE"},
    "s06_pruned_columns": {"last": "DOUBLE"},
    "s07_board_rows_read": {"channel_idx": "BIGINT", "t_sec": "DOUBLE"},
    "s09_plain_tables": {"fs": "BIGINT", "t_sec": "DOUBLE"},
    "s11_metadata": {"fs": "BIGINT", "n_channels": "BIGINT", "header_lines": "BIGINT"},
    "s08_board_map": {"n_cols": "BIGINT", "n_exg": "BIGINT", "board_fs": "BIGINT"},
    "p03_bands_of_bins": {"freq": "DOUBLE"},
    "x13_distance_surface": {"x": "DOUBLE", "y": "DOUBLE"},
    "w01_sliding_windows": {"center": "DOUBLE"},
    "w04_recovery_time": {"recovery_sec": "DOUBLE"},
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band shares by condition from the spectra of all epochs."""
    return base.QUERIES["flow_features"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    typed = lambda c: ", ".join(f"CAST({k} AS {t}) AS {k}" for k, t in c.items())
    return {n: f"SELECT * REPLACE ({typed(TYPES[n])}) FROM ({sql})" if n in TYPES else sql for n, sql in base.ORACLES.items()}
