"""Imports every query file, so that the registry is complete."""

from . import frame_queries, metric_queries, model_queries, text_queries  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
