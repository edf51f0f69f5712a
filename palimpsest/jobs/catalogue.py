"""All registered queries over the retrieval model, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.functions.registry import REGISTERED
from palimpsest.sources.model import MODEL_SQL, Store

MODULES = ["operators.lookup", "operators.metrics", "operators.retrieval", "operators.fusion", "operators.quality", "operators.lifecycle", "operators.telemetry", "operators.checkpoint", "operators.text", "operators.intent", "operators.upkeep", "operators.evidence", "operators.sampling", "operators.rollups", "streaming.turns", "streaming.turn_state", "streaming.reinforcement", "streaming.index_sync", "streaming.sinks"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"palimpsest.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: lambda spark, folder, f=entry.function: f(Store(spark, folder)) for name, entry in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: f"{MODEL_SQL}{',' if entry.sql.lstrip().startswith('+') else ''} {entry.sql.lstrip().lstrip('+')}" for name, entry in REGISTERED.items() if entry.sql}
