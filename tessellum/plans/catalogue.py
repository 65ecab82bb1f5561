"""The registered queries and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessellum.plans import analytics, artifacts, cascade, checks, evidence, feeds, forms, ingest, pages, rules, search, sections, state, studies, tables, vision

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**search.QUERIES, **evidence.QUERIES, **analytics.QUERIES, **ingest.QUERIES, **forms.QUERIES, **checks.QUERIES, **tables.QUERIES, **vision.QUERIES, **studies.QUERIES, **pages.QUERIES, **sections.QUERIES, **state.QUERIES, **feeds.QUERIES, **cascade.QUERIES, **rules.QUERIES, **artifacts.QUERIES}
ORACLE_SQL: dict[str, str] = {**search.ORACLE_SQL, **evidence.ORACLE_SQL, **analytics.ORACLE_SQL, **ingest.ORACLE_SQL, **forms.ORACLE_SQL, **checks.ORACLE_SQL, **tables.ORACLE_SQL, **vision.ORACLE_SQL, **studies.ORACLE_SQL, **pages.ORACLE_SQL, **sections.ORACLE_SQL, **state.ORACLE_SQL, **feeds.ORACLE_SQL, **cascade.ORACLE_SQL, **rules.ORACLE_SQL, **artifacts.ORACLE_SQL}
FLAGSHIP = "bm25_topk"
