"""One registered query per operator."""

from annolake.queries import detection, geometry, metrics, pairs, samples, sources, streams  # noqa: F401
from annolake.queries.registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
