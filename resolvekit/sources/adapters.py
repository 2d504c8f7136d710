"""Registry of source adapters: each turns raw rows of one provider into occurrences."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import content_id, name_key
from ..operators.quality import violations

#: Columns that an adapter's occurrences must have.
OCCURRENCE = ("provider", "source_type", "source_name", "source_record_id", "raw_name", "entity_type", "entity_id", "discovered_at")
_ADAPTERS: dict[str, tuple[str, str, Callable[[DataFrame], DataFrame]]] = {}


def register(adapter_id: str, provider: str, version: str, normalise: Callable[[DataFrame], DataFrame]) -> None:
    """Add an adapter; ids are lower-case words, versions v1, v2, ..."""
    for value, pattern, what in ((adapter_id, "[a-z][a-z0-9_]*", "adapter id"), (provider, "[a-z][a-z0-9_]*", "provider"), (version, "v[1-9][0-9]*", "version")):
        if not re.fullmatch(pattern, value):
            raise ValueError(f"invalid {what}: {value!r}")
    _ADAPTERS[adapter_id] = (provider, version, normalise)


def occurrences(adapter_id: str, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrences, violations) of an adapter's output: it has the columns, a name, an id, a time, and its own provider."""
    provider, version, normalise = _ADAPTERS[adapter_id]
    out = normalise(raw)
    missing = [c for c in OCCURRENCE if c not in out.columns]
    if missing:
        raise ValueError(f"adapter {adapter_id} lacks {missing}")
    out = out.withColumn("name_key", name_key("raw_name")).withColumn("adapter", F.lit(f"{adapter_id}:{version}"))
    out = out.withColumn("occurrence_id", content_id("provider", "source_type", "source_name", "source_record_id", "entity_type", "entity_id", "raw_name"))
    rules = {"provider": F.col("provider") == provider, "name": F.trim("raw_name") != "", "entity": F.col("entity_id").isNotNull(),
        "time": F.col("discovered_at").isNotNull()}
    bad = violations(out, "occurrence_id", rules)
    return out.join(bad.select(F.col("key").alias("occurrence_id")).distinct(), "occurrence_id", "left_anti"), bad
