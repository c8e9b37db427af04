"""Every operator as a query over the given tables, with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskweave.plans import dependencies, detection, network, rollups, targets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _part in (detection, rollups, dependencies, network, targets):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
