"""All registered queries and their oracle SQL, gathered from the plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylight.plans import crawl_queries, document_queries, search_queries, upkeep_queries, whole_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _plan in (search_queries, crawl_queries, document_queries, upkeep_queries, whole_queries):
    QUERIES |= _plan.QUERIES
    ORACLE |= _plan.ORACLE
