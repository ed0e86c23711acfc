"""All named queries and their SQL."""

from . import embeddings, frames, recordings, statistics, voice  # noqa: F401  (registration)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
