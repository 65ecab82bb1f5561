"""From raw documents to token ids: quality rules, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Any column
may be null, extra columns stay whatever their names, very long texts are taken whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessellum.llm import credentials, mixing, pieces, quality, simhash
from tessellum.llm.common import checkpointed, documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go. A null or empty text has too few words and goes; repeated rows are judged each alike."""
    return quality.quality_filter(docs, rules=quality.PIPELINE_RULES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a five-word-shingle similarity of 0.8 or more stays, the one of the least id.

    A null id comes last, ties go by a hash of id and text. Repeated rows are one document; null and blank texts are one group.
    """
    return simhash.without_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked; documents stay, repeated rows and null texts too. Spans that start together go by kind."""
    return credentials.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or up to three times.

    A null source is a source; null texts have no words, so copies of them count for nothing. Equal rows are drawn each on its own, equal ranks go by hash.
    """
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives the text again.

    A null text has null in all of it. Of equally good last pieces the longest wins; repeated rows each have theirs.
    """
    return pieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing_sources", mixing_sources),
    ("encoding", encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each over what the one before it left in the shared checkpoint folder."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
