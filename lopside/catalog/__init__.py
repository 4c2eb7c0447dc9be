"""Registered queries and their SQL twins."""

from lopside.catalog import evaluation, learning, neighborhood, sampling, tabular, trees
from lopside.catalog.learning import flagship

MODULES = [tabular, sampling, evaluation, neighborhood, learning, trees]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}

__all__ = ["ORACLES", "QUERIES", "flagship"]
