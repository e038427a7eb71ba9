"""Registered queries."""

from prefrank.plans import q_metrics, q_conform, q_pairs, q_datasets, q_entity, q_features, q_models, q_panel, q_resample, q_sources  # noqa: F401
from prefrank.plans.registry import ORACLES, QUERIES  # noqa: F401
