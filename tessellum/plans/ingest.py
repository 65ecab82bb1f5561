"""Queries over page elements, XML, citations and confidences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.functions import text
from tessellum.operators import ingest
from tessellum.plans import evidence, search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 S2 I2."""
    return ingest.page_elements(_table(spark, sf_dir, "pages"), "page_id", "html").withColumnRenamed("id", "page_id")


def xml_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a report with a namespace prefix; every tenth is cut short."""
    whole = F.concat(F.lit('<m:Report xmlns:m="urn:x"><m:Name>'), "c_name", F.lit("</m:Name><m:Segment>"), "c_mktsegment", F.lit("</m:Segment></m:Report>"))
    docs = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.lit("<m:Report><m:Name>")).otherwise(whole).alias("xml"))
    return ingest.xml_fields(docs, "c_custkey", "xml", {"name": "Name", "segment": "Segment", "missing": "Nothing"})


def citations_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five hits of each benchmark text."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return ingest.citations(search.bm25_topk(spark, sf_dir).join(docs, "id"))


def citation_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 W3."""
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return ingest.citation_confidence(asked, search.bm25_topk(spark, sf_dir).where("rank <= 5"))


def agent_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lesser of the mean of all fields and the least of the critical ones."""
    merged = evidence.merge_tiers(spark, sf_dir)
    least = F.min(F.when(F.col("field").isin(evidence.CRITICAL), F.col("confidence")))
    return merged.groupBy("doc_id").agg(F.round(F.least(F.avg("confidence"), least), 6).alias("confidence"))


def cost_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines against its price, in cents, and the percent, halves towards plus infinity."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("actual"))
    price = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = _table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    variance = F.col("actual") - price
    return rows.select("o_orderkey", variance.alias("variance"), F.when(price == 0, 0.0).otherwise(text.half_up(variance * 100.0 / price)).alias("percent"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (page_elements, xml_fields, citations_topn, citation_confidence, agent_confidence, cost_variance)}

_BARE = r"regexp_replace(coalesce(html, ''), '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g')"
_LISTS = " UNION ALL ".join(
    rf"SELECT page_id, '{kind}' AS element_type, unnest(range(len(x))) AS seq, unnest(x) AS raw FROM (SELECT page_id, regexp_extract_all({_BARE}, '(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>', 1) AS x FROM pages)"
    for kind, tag in ingest.TAGS.items()
)
_HITS = search.ORACLE_SQL["bm25_topk"]
ORACLE_SQL: dict[str, str] = {
    "page_elements": rf"""SELECT page_id, element_type, CAST(seq AS INT) AS seq, text FROM (SELECT *, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM ({_LISTS})) WHERE text <> ''""",
    "xml_fields": """SELECT c_custkey AS id, 'name' AS field, c_name AS value, CAST(1 AS DOUBLE) AS confidence FROM customer WHERE c_custkey % 10 <> 0
UNION ALL SELECT c_custkey, 'segment', c_mktsegment, 1 FROM customer WHERE c_custkey % 10 <> 0""",
    "citations_topn": f"SELECT query_id, rank AS place, id, substr(text, 1, 500) AS excerpt FROM ({_HITS}) JOIN documents ON doc_id = id WHERE rank <= 5",
    "citation_confidence": f"""WITH h AS ({_HITS}), n AS (SELECT item_id AS query_id, count(h.id) AS n FROM benchmark LEFT JOIN h ON item_id = query_id AND rank <= 5 GROUP BY item_id)
SELECT query_id, CAST(CASE WHEN n = 0 THEN 0.3 WHEN n <= 2 THEN 0.7 ELSE 0.9 END AS DOUBLE) AS confidence, n = 0 AS needs_review FROM n""",
    "agent_confidence": f"SELECT doc_id, round(least(avg(confidence), min(confidence) FILTER (field <> 'priority')), 6) AS confidence FROM ({evidence.ORACLE_SQL['merge_tiers']}) GROUP BY doc_id",
    "cost_variance": """WITH l AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS a FROM lineitem GROUP BY l_orderkey), o AS (SELECT o_orderkey, a, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders JOIN l ON o_orderkey = l_orderkey)
SELECT o_orderkey, CAST(a - p AS BIGINT) AS variance, CASE WHEN p = 0 THEN 0 ELSE floor(CAST(a - p AS DOUBLE) * 100 / p + 0.5) END AS percent FROM o""",
}
