"""All registered queries of the library and their SQL."""

from . import columns, fields, loops, matrices, meshes, spatial, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
