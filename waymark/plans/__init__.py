"""Queries over the test tables, each with its SQL twin."""

from . import core, learned, meaning, scoring, whole
from .core import flagship

QUERIES = {**core.QUERIES, **meaning.QUERIES, **scoring.QUERIES, **whole.QUERIES, **learned.QUERIES}
ORACLES = {**core.ORACLES, **meaning.ORACLES, **scoring.ORACLES, **whole.ORACLES, **learned.ORACLES}

__all__ = ["ORACLES", "QUERIES", "flagship"]
