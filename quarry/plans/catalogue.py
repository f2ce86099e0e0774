"""All registered queries of the engine and the SQL each is held against."""

from __future__ import annotations

from quarry.operators import access, alignment, evaluation, graph, induction, language, postings, relational, retrieval, statistics, surfaces, temporal, walks, writes  # noqa: F401
from quarry.functions import text  # noqa: F401
from quarry.sources import readers  # noqa: F401
from quarry.streaming import folds  # noqa: F401
from quarry.plans.registry import OPERATORS, QUERIES, SQL

__all__ = ["OPERATORS", "QUERIES", "SQL"]
