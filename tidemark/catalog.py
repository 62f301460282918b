"""All queries of the library with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from .plans import analytics, assurance, etl, facts, lineage, marts, remediation, stages  # noqa: F401  each registers its queries
from .plans.registry import ORACLE, QUERIES  # noqa: F401
