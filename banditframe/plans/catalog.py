"""The registered queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from banditframe.plans import q_interactions, q_more, q_policies, q_profile, q_results, q_sources, q_streaming

GROUPS = [q_results, q_interactions, q_policies, q_profile, q_sources, q_streaming, q_more]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for g in GROUPS for name, f in g.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for g in GROUPS for name, sql in g.SQL.items()}
