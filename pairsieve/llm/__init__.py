"""Operators of a training-data pipeline: each module is one operator; ``queries`` names them."""

from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
