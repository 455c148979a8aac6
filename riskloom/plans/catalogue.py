"""Every query over the driver's tables, with the SQL whose rows it must equal."""

from __future__ import annotations

from riskloom.plans import contract_queries, feature_queries, metric_queries, model_queries, monitor_queries, rule_queries  # noqa: F401  they register their queries
from riskloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
