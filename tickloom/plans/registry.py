"""All queries of the library but those of the training-data subpackage."""

from . import confluence, extra, models, more  # noqa: F401  register their queries
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
