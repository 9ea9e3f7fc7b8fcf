"""Import every query module so the registry is filled."""

from . import q_folds, q_models, q_pipeline, q_prep, q_screen, q_search, q_survival  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
