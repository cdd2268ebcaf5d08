"""All registered queries: importing this module fills the registry."""

from labelops.plans import (  # noqa: F401
    balance_queries,
    metric_queries,
    model_queries,
    shape_queries,
    source_queries,
    stat_queries,
    text_queries,
)
from labelops.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
