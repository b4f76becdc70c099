"""All registered queries of the rule-table engine with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rulelens.operators import alignment, answers, clauses, clitics, constructions, context, coverage, discourse, evaluation, frames, gates, graph, knowledge, lookup, mining, morphology, normalizing, references, scalars, segmenter, sweep, textgraph, tokens
from rulelens.sources import typed_json
from rulelens.streaming import trackers

FLAGSHIP = "claims_by_marker"
MODULES = (normalizing, tokens, lookup, morphology, alignment, segmenter, clauses, frames, clitics, context, discourse, gates, graph, references, gates, knowledge, textgraph, answers, constructions, mining, coverage, evaluation, sweep, scalars, trackers, typed_json)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
