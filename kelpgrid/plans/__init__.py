"""Registered queries; importing the package fills the registry."""

from kelpgrid.plans import density_queries, grid_queries, model_queries, source_queries, transfer_queries, transform_queries, trial_queries  # noqa: F401
from kelpgrid.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
