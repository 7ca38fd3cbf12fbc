"""Imports every query module; the registry is complete after this import."""

from gridmark.workload import q_audit, q_metrics, q_regions, q_runs, q_sources, q_sweep, q_tiling  # noqa: F401
from gridmark.workload.registry import QUERIES, sql_twins  # noqa: F401
