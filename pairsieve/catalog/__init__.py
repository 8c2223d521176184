"""Named queries over the test tables, each with the SQL it must agree with where SQL can say it."""

from . import fits, metrics, pairs, stores, state, texts, vectors  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
