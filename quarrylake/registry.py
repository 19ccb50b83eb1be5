"""Every query of the library proper, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

PLANS = ("retrieval", "dedup", "reports", "sessions", "texts", "checks", "scalars", "loads", "metrics", "cleaning")



def of(plan: str) -> list[str]:
    """Names of a plan's queries."""
    return list(import_module(f"quarrylake.plans.{plan}").QUERIES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _name in PLANS:
    _plan = import_module(f"quarrylake.plans.{_name}")
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
