"""All queries over the test tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from . import gateway_queries, transform_queries, workloads  # noqa: F401  they register their queries
from .workloads import ORACLE_SQL, QUERIES, flagship  # noqa: F401
