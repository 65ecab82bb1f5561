"""Pages and XML to typed elements and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Element types and their tags.
TAGS = {"title": "h1", "paragraph": "p", "list_item": "li"}


def _plain(html: Column) -> Column:
    """Text of markup: tags become blanks, white space is collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"[ \t\r\n]+", " "))


def page_elements(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, element_type, seq, text) of the titles, paragraphs and list items of pages, seq from 0 within a type.

    Scripts, styles and comments are no text; elements without text are dropped but counted; a null page has none.
    """
    bare = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    found = pages.select(F.col(id_col).alias("id"), bare.alias("html"))
    lists = [_typed(F.regexp_extract_all("html", F.lit(f"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>"), F.lit(1)), kind) for kind, tag in TAGS.items()]
    return found.select("id", F.inline(F.concat(*lists))).where("text <> ''")


def _typed(texts: Column, kind: str) -> Column:
    return F.transform(texts, lambda x, i: F.struct(F.lit(kind).alias("element_type"), i.alias("seq"), _plain(x).alias("text")))


def xml_fields(docs: DataFrame, id_col: str, xml_col: str, fields: dict[str, str]) -> DataFrame:
    """(id, field, value, confidence): elements by their name, whatever their namespace prefix, at confidence 1.

    fields: field name -> element name below the root. Malformed XML, null and missing elements give no row.
    """
    bare = F.regexp_replace(F.col(xml_col), r"<(/?)[A-Za-z_][\w.-]*:", "<$1")
    parsed = F.from_xml(bare, ", ".join(f"`{e}` string" for e in fields.values()))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col("x")[e].alias("value")) for f, e in fields.items()])
    found = docs.select(F.col(id_col).alias("id"), parsed.alias("x")).select("id", F.inline(rows))
    return found.where("value is not null").withColumn("confidence", F.lit(1.0))


def citations(hits: DataFrame, limit: int = 5, length: int = 500) -> DataFrame:
    """The first `limit` hits of each query as citations (query_id, place, id, excerpt)."""
    return hits.where(F.col("rank") <= limit).select("query_id", F.col("rank").alias("place"), "id", F.substring("text", 1, length).alias("excerpt"))


def citation_confidence(asked: DataFrame, cited: DataFrame) -> DataFrame:
    """Confidence of each query by its citations, 0.3 without, 0.7 for one or two, 0.9 for more, and review without any."""
    n = cited.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = asked.join(n, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("query_id", F.when(F.col("n") == 0, 0.3).when(F.col("n") <= 2, 0.7).otherwise(0.9).alias("confidence"), (F.col("n") == 0).alias("needs_review"))
