"""The query over ordered dictionaries of phrases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.operators import rules
from tessellum.sources.tables import table

#: (rules, what they say), in the order in which they are asked.
DICTIONARIES = (
    (rules.COMPONENTS, ("section", "life", "asset_class")), (rules.CATEGORIES, ("category",)), (rules.ATTACHMENTS, ("attachment",)), (rules.SPACES, ("space",)), (rules.PROPERTIES, ("property_class", "recovery")),
)
_PHRASES = [p for known, _ in DICTIONARIES for p, *_ in known]
#: Parts said to be one to three things of the dictionaries, in all kinds of letters; SQL that both engines read.
_SAID = ["p_partkey", "p_partkey * 7 + p_size", "p_partkey * 3 + 11"]


def _text(case: Callable[[str], str]) -> str:
    picks = [case(f"({s}) % {len(_PHRASES) + 6}") for s in _SAID]
    return f"concat(p_name, ' ', {picks[0]}, ' and ', upper({picks[1]}), CASE WHEN p_partkey % 4 = 0 THEN concat(' in the ', {picks[2]}, 's') ELSE '' END)"


def _case(at: str) -> str:
    return f"CASE {at} {' '.join(f'WHEN {i} THEN ' + chr(39) + p + chr(39) for i, p in enumerate(_PHRASES))} ELSE 'thing' END"


def component_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by what their text says they are."""
    found = table(spark, sf_dir, "part").select("p_partkey", F.expr(_text(_case)).alias("text"))
    for known, names in DICTIONARIES:
        found = rules.labelled(found, "text", known, *names)
    return found.drop("text")


def _said_sql(known: tuple[tuple[str, ...], ...], k: int, name: str) -> str:
    return f"CASE {' '.join(f'WHEN contains(t, {chr(39)}{r[0]}{chr(39)}) THEN {chr(39)}{r[k]}{chr(39)}' for r in known)} END AS {name}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"component_rules": component_rules}
ORACLE_SQL: dict[str, str] = {
    "component_rules": f"SELECT p_partkey, {', '.join(_said_sql(known, k, name) for known, names in DICTIONARIES for k, name in enumerate(names, 1))} FROM (SELECT p_partkey, lower({_text(_case)}) AS t FROM part)"
}
