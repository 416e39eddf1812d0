"""The query catalogue: importing the modules fills the registry."""

from . import abbreviations, corpus, files, keys, modelling, timing  # noqa: F401
from .base import ORACLES, QUERIES, Query

__all__ = ["ORACLES", "QUERIES", "Query"]
