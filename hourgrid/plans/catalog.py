"""All registered queries."""
from __future__ import annotations

from hourgrid.plans.etl_queries import TABLE_QUERIES
from hourgrid.plans.feature_queries import FEATURE_QUERIES
from hourgrid.plans.grid_queries import GRID_QUERIES
from hourgrid.plans.model_queries import MODEL_QUERIES
from hourgrid.plans.registry import Query, collect
from hourgrid.plans.scoring_queries import SCORING_QUERIES
from hourgrid.plans.window_queries import WINDOW_QUERIES

QUERIES: dict[str, Query] = collect(GRID_QUERIES, TABLE_QUERIES, WINDOW_QUERIES, FEATURE_QUERIES,
                                    SCORING_QUERIES, MODEL_QUERIES)
