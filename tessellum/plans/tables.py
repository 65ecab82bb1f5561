"""Queries over tables of cells, typed values, and chunks with what they are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.functions import typed
from tessellum.operators import chunks, grid, layout

#: Fields to read and texts to read them from, in all pairs.
FIELDS = ["contract_price", "year_built", "prior_sale_price", "bathrooms_above_grade", "depreciation_total", "city"]
TEXTS = [" $1,234.50 ", "abc", "", "2,000 sq ft", "12.5", "-7", "1.2.3", "1999"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each customer: comparables, costs, a subject or nothing known."""
    sales = ["'Feature'", "'Subject'", "'Comparable 1'", "'Comparable 2'", "'Comparable 3'", "'More'", "'Sale Price ($)'", "''", "concat('$', k * 10)", "if(k % 3 = 0, ' ', concat('$', k))", "p", "'x'", "' Area  (sq ft)'", "'1'", "if(k % 5 = 0, null, '12')", "if(k % 3 = 0, null, '13')", "'14'", "'15'"]
    costs = ["'Opinion of Site Value'", "concat('$', k, ',500')", "'x'", "'TOTAL COST NEW'", "if(k % 3 = 0, 'unknown', concat(k, '.75'))", "'y'", "'Depreciation'", "'5'", "null"]
    subject = ["concat('Property Address ', a, ' City Boise State ID')", "concat('Zip Code ', 83000 + k % 700)", "concat('county Ada Borrower ', n, '  Owner of record')"]
    kinds = [(6, sales), (3, costs), (3, subject), (2, ["'Item'", "'Value'"])]
    arrays = [f"array({', '.join(f'struct({i // width} AS row, {i % width} AS col, CAST({c} AS string) AS content)' for i, c in enumerate(cells))})" for width, cells in kinds]
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_mktsegment AS p", "concat(c_custkey, ' ', c_mktsegment) AS a", "c_name AS n")
    case = " ".join(f"WHEN {i} THEN {a}" for i, a in enumerate(arrays))
    return rows.selectExpr("k AS table_id", f"inline(CASE k % 4 {case} END)", "k % 10 / 10 AS confidence").select("table_id", "row", "col", "content", F.col("confidence").cast("double").alias("confidence"))


def table_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X35."""
    return grid.kinds(_cells(spark, sf_dir))


def table_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X36 X37 X38 X39 X44."""
    return grid.table_fields(_cells(spark, sf_dir))


def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9."""
    return grid.table_text(_cells(spark, sf_dir))


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of FIELDS and TEXTS, a part each."""
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"cast({by} % {len(values)} as int) + 1"))
    field, value = pick(FIELDS, "p_partkey"), pick(TEXTS, "floor(p_partkey / 6)")
    made = _table(spark, sf_dir, "part").select("p_partkey", field.alias("f"), value.alias("v"))
    f, v = F.col("f"), F.col("v")
    return made.select("p_partkey", typed.service_value(f, v).alias("service"), typed.xml_value(f, v).alias("xml"), typed.vision_value(F.concat(F.lit("a.b."), f), v).alias("vision"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document as an element, forty a page."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "text")).selectExpr("doc_id", "seq", "1 + seq DIV 40 AS page", "seq AS element_id", "text")


def chunk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole documents of lines, with pages and lines."""
    found = chunks.document_windows(_lines(spark, sf_dir))
    return found.select("doc_id", "chunk", "n_tokens", F.md5("text").alias("text_md5"), "first_page", "last_page", F.array_join("element_ids", ",").alias("element_ids"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with fonts, indents and starts of all kinds."""
    start = "element_at(array('', '- ', '12) ', 'b. ', '(iv) ', 'Section 4 ', '1.2 A', ''), CAST(seq % 8 AS int) + 1)"
    text = f"CASE WHEN seq % 11 = 5 THEN 'ALL CAPS LINE' ELSE concat({start}, text) END"
    return _lines(spark, sf_dir).selectExpr("doc_id", "page", "seq", f"{text} AS text", "CAST((doc_id * 7 + seq * 3) % 90 AS double) AS x0", "CAST(8 + (doc_id + seq) % 9 AS double) AS font", "(doc_id + seq) % 3 = 0 AS bold")


def element_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I2."""
    return layout.element_types(_blocks(spark, sf_dir), ["doc_id", "page"]).select("doc_id", "seq", "element_type")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (table_kinds, table_fields, table_text, typed_values, chunk_sources, element_types)}

_CELLS = """
s AS (SELECT c_custkey AS k, c_mktsegment AS p, c_custkey || ' ' || c_mktsegment AS a, c_name AS n FROM customer),
g AS (SELECT k, 'Feature' AS x, 0 AS r, 0 AS c FROM s WHERE false
 UNION ALL SELECT k, unnest(['Feature', 'Subject', 'Comparable 1', 'Comparable 2', 'Comparable 3', 'More']), 0, unnest(range(6)) FROM s WHERE k % 4 = 0
 UNION ALL SELECT k, unnest(['Sale Price ($)', '', '$' || k * 10, CASE WHEN k % 3 = 0 THEN ' ' ELSE '$' || k END, p, 'x']), 1, unnest(range(6)) FROM s WHERE k % 4 = 0
 UNION ALL SELECT k, unnest([' Area  (sq ft)', '1', CASE WHEN k % 5 <> 0 THEN '12' END, CASE WHEN k % 3 <> 0 THEN '13' END, '14', '15']), 2, unnest(range(6)) FROM s WHERE k % 4 = 0
 UNION ALL SELECT k, unnest(['Opinion of Site Value', '$' || k || ',500', 'x']), 0, unnest(range(3)) FROM s WHERE k % 4 = 1
 UNION ALL SELECT k, unnest(['TOTAL COST NEW', CASE WHEN k % 3 = 0 THEN 'unknown' ELSE k || '.75' END, 'y']), 1, unnest(range(3)) FROM s WHERE k % 4 = 1
 UNION ALL SELECT k, unnest(['Depreciation', '5', NULL]), 2, unnest(range(3)) FROM s WHERE k % 4 = 1
 UNION ALL SELECT k, unnest(['Property Address ' || a || ' City Boise State ID', 'Zip Code ' || (83000 + k % 700), 'county Ada Borrower ' || n || '  Owner of record']), 0, unnest(range(3)) FROM s WHERE k % 4 = 2
 UNION ALL SELECT k, unnest(['Item', 'Value']), 0, unnest(range(2)) FROM s WHERE k % 4 = 3),
t AS (SELECT k, string_agg(x, ' ' ORDER BY r, c) AS x FROM g WHERE x <> '' GROUP BY k)"""
_COMPARED = """
v AS (SELECT k, c, 'sale_price' AS n, trim(x) AS x FROM g WHERE k % 4 = 0 AND r = 1 AND c BETWEEN 2 AND 4 AND trim(x) <> '' UNION ALL SELECT k, c, 'area_sq_ft', x FROM g WHERE k % 4 = 0 AND r = 2 AND c BETWEEN 2 AND 4 AND x IS NOT NULL
 UNION ALL SELECT k, c, 'feature', x FROM g WHERE k % 4 = 0 AND r = 0 AND c BETWEEN 2 AND 4),
j AS (SELECT k, c, '{' || string_agg('"' || n || '":"' || x || '"', ',' ORDER BY n) || '}' AS x FROM v GROUP BY k, c)"""
_PICK = "SELECT p_partkey AS k, {f}[p_partkey % 6 + 1] AS f, {v}[p_partkey // 6 % 8 + 1] AS v FROM part".format(f=FIELDS, v=TEXTS)
_WORD = r"list_filter(regexp_split_to_array(x, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"
ORACLE_SQL: dict[str, str] = {
    "table_kinds": "SELECT c_custkey AS table_id, ['sales_comparison', 'cost_approach', 'subject'][c_custkey % 4 + 1] AS kind FROM customer WHERE c_custkey % 4 < 3",
    "table_text": f"WITH {_CELLS} SELECT k AS table_id, x AS text FROM t",
    "table_fields": f"""WITH {_CELLS}, {_COMPARED}
SELECT k AS table_id, 'sales_comparison' AS section, 'comparable_' || row_number() OVER (PARTITION BY k ORDER BY c) AS field, x AS value, CAST(0.85 AS DOUBLE) AS confidence FROM j
UNION ALL SELECT k, 'cost_approach', 'site_value', k || '500', CASE WHEN k % 10 = 0 THEN 0.85 ELSE k % 10 / 10 END FROM s WHERE k % 4 = 1
UNION ALL SELECT k, 'cost_approach', 'total_cost_new', CASE WHEN k % 3 = 0 THEN '0' ELSE CAST(k AS VARCHAR) END, CASE WHEN k % 10 = 0 THEN 0.85 ELSE k % 10 / 10 END FROM s WHERE k % 4 = 1
UNION ALL SELECT k, 'subject', unnest(['property_address', 'city', 'state', 'zip', 'county', 'borrower']), unnest([a, 'Boise', 'ID', CAST(83000 + k % 700 AS VARCHAR), 'Ada', n]), 0.85 FROM s WHERE k % 4 = 2""",
    "typed_values": rf"""WITH p AS ({_PICK}), c AS (SELECT *, trim(v) AS t, regexp_replace(v, '[$,\s]', '', 'g') AS a, regexp_replace(v, '[^\d.]', '', 'g') AS d FROM p),
w AS (SELECT *, CAST(CAST(trunc(TRY_CAST(a AS DOUBLE)) AS BIGINT) AS VARCHAR) AS ai, CAST(CAST(trunc(TRY_CAST(d AS DOUBLE)) AS BIGINT) AS VARCHAR) AS di, trim(regexp_replace(v, '[$,]', '', 'g')) AS b FROM c)
SELECT k AS p_partkey, CASE WHEN v = '' THEN v WHEN f IN ('contract_price', 'prior_sale_price') THEN coalesce(ai, '0') WHEN f = 'year_built' THEN coalesce(di, t) ELSE t END AS service,
CASE WHEN f IN ('contract_price', 'depreciation_total') THEN coalesce(CASE WHEN contains(b, '.') THEN CAST(TRY_CAST(b AS DOUBLE) AS VARCHAR) ELSE CAST(TRY_CAST(b AS BIGINT) AS VARCHAR) END, t)
 WHEN f = 'year_built' AND NOT contains(t, '.') THEN coalesce(CAST(TRY_CAST(t AS BIGINT) AS VARCHAR), t) WHEN f = 'bathrooms_above_grade' THEN coalesce(CAST(TRY_CAST(t AS DOUBLE) AS VARCHAR), t) ELSE t END AS xml,
CASE WHEN f = 'contract_price' THEN coalesce(ai, v) WHEN f = 'year_built' THEN coalesce(di, v) ELSE v END AS vision FROM w""",
    "chunk_sources": f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS seq FROM documents),
w AS (SELECT doc_id, seq, unnest({_WORD}) AS w, unnest(range(len({_WORD}))) AS i FROM l), t AS (SELECT *, 1 + seq // 40 AS page, row_number() OVER (PARTITION BY doc_id ORDER BY seq, i) - 1 AS t, count(*) OVER (PARTITION BY doc_id) AS n FROM w),
c AS (SELECT *, unnest(range(greatest(0, CAST(ceil((t - 399) / 320) AS BIGINT)), 1 + least(t // 320, greatest(0, CAST(ceil((n - 400) / 320) AS BIGINT))))) AS c FROM t),
g AS (SELECT doc_id, c, count(*) AS n, string_agg(w, ' ' ORDER BY t) AS x, max(seq) AS last, list(DISTINCT seq) FILTER (c = 0 OR t >= 80 + c * 320) AS ids, min(page) FILTER (c = 0 OR t >= 80 + c * 320) AS p, max(page) AS q FROM c GROUP BY doc_id, c),
b AS (SELECT *, lag(last) OVER k AS before, max(q) OVER (PARTITION BY doc_id ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM g WINDOW k AS (PARTITION BY doc_id ORDER BY c))
SELECT doc_id, CAST(c AS INT) AS chunk, CAST(n AS INT) AS n_tokens, md5(x) AS text_md5, least(p, coalesce(seen, p)) AS first_page, q AS last_page,
array_to_string(list_sort(list_distinct(list_concat(ids, CASE WHEN before IS NULL THEN [] ELSE [before] END))), ',') AS element_ids FROM b""",
    "element_types": r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS seq FROM documents),
b AS (SELECT doc_id, seq, 1 + seq // 40 AS page, CASE WHEN seq % 11 = 5 THEN 'ALL CAPS LINE' ELSE ['', '- ', '12) ', 'b. ', '(iv) ', 'Section 4 ', '1.2 A', ''][seq % 8 + 1] || x END AS x, (doc_id * 7 + seq * 3) % 90 AS x0, 8 + (doc_id + seq) % 9 AS font, (doc_id + seq) % 3 = 0 AS bold FROM l),
a AS (SELECT *, avg(x0) OVER (PARTITION BY doc_id, page) AS mean FROM b)
SELECT doc_id, CAST(seq AS INT) AS seq, CASE WHEN length(regexp_replace(x, '^\s+|\s+$', '', 'g')) < 3 THEN 'paragraph'
WHEN regexp_matches(x, '^([-–—]\s|\d{1,3}[.)]\s|[a-zA-Z][.)]\s|\([a-zA-Z0-9]+\)\s)') OR (x0 > mean + 30 AND length(x) < 200) THEN 'list_item' WHEN font >= 14 AND bold THEN 'title'
WHEN (bold AND font >= 11 AND length(x) < 150) OR regexp_matches(x, '^(Chapter|Section|Part|Article)\s+\d+') OR regexp_matches(x, '^[A-Z][A-Z\s]{3,50}$') OR regexp_matches(x, '^\d+\.\d+\.?\s+[A-Z]') THEN 'heading' ELSE 'paragraph' END AS element_type FROM a""",
}
