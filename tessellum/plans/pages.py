"""Queries over pages of positioned words: lines, elements in order, tables of cells."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.operators import chunks, layout, pages

#: Words of documents on pages of forty rows, in steps of three down each row, so that a row is more than one line; wrapped
#: every sixteen words. The columns read the same in both engines.
WORDS = (
    "doc_id", "CAST(floor(line_no / 40) AS BIGINT) + 1 AS page", "CAST(line_no * 100000 + k AS BIGINT) AS seq", "word AS text",
    "CAST(50 + (k % 16) * 30 AS DOUBLE) AS x0", "CAST(40 + (line_no % 40) * 14 + (k % 4) * 3 + floor(k / 16) * 0.5 AS DOUBLE) AS top",
    "CAST(50 + (k % 16) * 30 + length(word) * 5 AS DOUBLE) AS x1", "CAST(50 + (line_no % 40) * 14 + (k % 4) * 3 + floor(k / 16) * 0.5 AS DOUBLE) AS bottom",
    "CASE WHEN k % 5 = 4 THEN NULL ELSE CAST(9 + (line_no * 5 + doc_id) % 7 AS DOUBLE) END AS size",
    "CASE WHEN (line_no * 3 + k) % 17 = 0 THEN 'Times-Bold' WHEN k % 3 = 0 THEN NULL ELSE 'Times' END AS font_name", "line_no", "k",
)
#: Up to three boxes a page: side by side, flat ones, and one within the first or, on odd pages, touching it.
BOXES = (
    "doc_id", "page", "CAST(t AS INT) AS number",
    "CAST(CASE WHEN t = 2 THEN 60 ELSE 50 + t * 180 END AS DOUBLE) AS x0", "CAST(CASE WHEN t = 2 THEN 75 + (page % 2) * 30 ELSE 68 + t * 112 + doc_id % 3 END AS DOUBLE) AS y0",
    "CAST(CASE WHEN t = 2 THEN 100 ELSE 230 + t * 150 END AS DOUBLE) AS x1", "CAST(CASE WHEN t = 2 THEN 80 + (page % 2) * 30 ELSE 68 + t * 112 + doc_id % 3 + ((doc_id + t) % 4) * 14 END AS DOUBLE) AS y1",
)
#: Cells of the tables: the words of a page's first three rows, four a row; some blank, some rows wholly, as many rows as the number says.
CELLS = (
    "doc_id", "page", "CAST(line_no % 40 AS INT) AS number", "CAST(floor(k / 4) AS INT) AS r", "CAST(k % 4 AS INT) AS c",
    "CASE WHEN floor(k / 4) = 1 AND doc_id % 3 = 0 THEN ' ' WHEN (floor(k / 4) + k + doc_id) % 6 = 0 THEN NULL ELSE concat(' ', text) END AS cell",
)
IN_TABLE = "line_no % 40 < 3 AND k < ((doc_id + page + line_no) % 6) * 4"
RULED = "(doc_id * 7 + page) % 3 <> 0"
#: Bytes of text of a partition of pages, on average.
BYTES = 4_000_000


def _parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of about BYTES of text. A word's row is some thirty times its text, so the session's number may be too few."""
    size = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    return max(1, math.ceil((size or 0) / BYTES))


def _pages(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """(doc_id, page, lines) of documents. Texts are dealt by page before they are words, which then stay with their page."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    text = table.select("doc_id", F.split("text", "\n").alias("l"))
    cut = F.expr("transform(sequence(0, CAST(floor((size(l) - 1) / 40) AS INT)), p -> slice(l, p * 40 + 1, 40))")
    each = text.select("doc_id", F.posexplode(cut).alias("p", "lines")).select("doc_id", (F.col("p") + 1).cast("long").alias("page"), "lines")
    return each.repartition(parts, "doc_id", "page")


def _words(sheets: DataFrame) -> DataFrame:
    lines = sheets.select("doc_id", "page", F.posexplode("lines").alias("n", "line")).select("doc_id", "page", F.expr("(page - 1) * 40 + n").alias("line_no"), "line")
    words = lines.select("doc_id", "page", "line_no", F.posexplode(F.split("line", " ")).alias("k", "word")).where("word <> ''")
    # the page as it is, by which words are known to be dealt
    return words.selectExpr(WORDS[0], "page", *WORDS[2:])


def _boxes(sheets: DataFrame) -> DataFrame:
    worded = sheets.where(F.exists("lines", lambda x: F.trim(x) != ""))
    each = worded.select("doc_id", "page").distinct().withColumn("tables", F.expr("CAST((doc_id + page) % 4 AS INT)"))
    return each.where("tables > 0").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tables") - 1))).selectExpr(*BOXES)


def _cells(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (doc_id, page, number, cells) by ruled lines, and by aligned text, whose cells end in a star."""

    def tables(cells: DataFrame) -> DataFrame:
        row = cells.groupBy("doc_id", "page", "number", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "cell"))), lambda s: s["cell"]).alias("row"))
        return row.groupBy("doc_id", "page", "number").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "row"))), lambda s: s["row"]).alias("cells"))

    cells = words.where(IN_TABLE).selectExpr(*CELLS)
    # by the page of the line, which is known only after the exchange of pages, so that both kinds read the same one
    by_line = words.where(IN_TABLE).where(RULED.replace("page", "(CAST(floor(line_no / 40) AS BIGINT) + 1)")).selectExpr(*CELLS)
    return tables(by_line), tables(cells.withColumn("cell", F.concat("cell", F.lit("*"))))


def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all words of documents."""
    found = pages.word_lines(_words(_pages(spark, sf_dir, _parts(spark, sf_dir))), ["doc_id", "page"])
    return found.select("doc_id", "page", "line", F.md5("text").alias("text"), "x0", "y0", "x1", "y1", F.round("font", 6).alias("font"), "bold")


def page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and paragraphs of each page, numbered through the document."""
    sheets = _pages(spark, sf_dir, _parts(spark, sf_dir))
    found = pages.page_elements(pages.word_lines(_words(sheets), ["doc_id", "page"]), _boxes(sheets), "doc_id", "page")
    return found.withColumn("text", F.md5("text"))


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: tables with headers, cells, captions and elements; the first line of each page is a caption."""
    parts = _parts(spark, sf_dir)
    sheets = _pages(spark, sf_dir, parts)
    words = _words(sheets)
    boxes, (ruled, aligned) = _boxes(sheets), _cells(words)
    lines = pages.word_lines(words, ["doc_id", "page"], parts=parts)
    told = lines.withColumn("text", F.when(F.col("line") % 5 == 2, F.concat(F.lit("Table 4: "), "text")).otherwise(F.col("text")))
    elements = pages.page_elements(lines, boxes, "doc_id", "page")
    found = pages.page_tables(ruled, aligned, boxes, elements, told, "doc_id", "page")
    found = found.withColumn("markdown", F.md5(chunks.markdown(F.col("headers"), F.col("rows")))).withColumn("n_rows", F.size("rows"))
    return found.withColumn("headers", F.array_join("headers", "|")).select("doc_id", "page", "seq", "table_id", "headers", "markdown", "n_rows", "caption", "element_id", "y0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (word_lines, page_assembly, page_tables)}

_WORDS = f"""w AS (SELECT {', '.join(WORDS)} FROM (SELECT doc_id, line_no, unnest(range(len(x))) AS k, unnest(x) AS word FROM (
 SELECT doc_id, unnest(range(len(l))) AS line_no, string_split(unnest(l), ' ') AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) WHERE word <> ''),
chain AS (SELECT doc_id, page, min(top) AS first FROM w GROUP BY doc_id, page UNION ALL SELECT w.doc_id, w.page, min(w.top) FROM chain c JOIN w ON w.doc_id = c.doc_id AND w.page = c.page AND w.top > c.first + {pages.SAME_LINE} GROUP BY w.doc_id, w.page, c.first),
a AS (SELECT *, lead(first, 1, 1e300) OVER (PARTITION BY doc_id, page ORDER BY first) AS until, row_number() OVER (PARTITION BY doc_id, page ORDER BY first) - 1 AS line FROM chain),
l AS (SELECT w.doc_id, w.page, CAST(a.line AS INT) AS line, trim(string_agg(text, ' ' ORDER BY top, x0, seq)) AS text, min(x0) AS x0, min(top) AS y0, max(x1) AS x1, max(bottom) AS y1, coalesce(avg(size), {pages.PLAIN_FONT}) AS font, coalesce(bool_or(contains(lower(font_name), 'bold')), false) AS bold
 FROM w JOIN a ON w.doc_id = a.doc_id AND w.page = a.page AND w.top >= first AND w.top < until GROUP BY w.doc_id, w.page, a.line),
b AS (SELECT {', '.join(BOXES)} FROM (SELECT doc_id, page, unnest(range((doc_id + page) % 4)) AS t FROM (SELECT DISTINCT doc_id, page FROM w)))"""
_NEAR = f"x[1].y0 - acc[-1].y1 < {layout.GAP} AND abs(x[1].font - acc[-1].font) < {layout.FONT} AND abs(x[1].x0 - acc[-1].x0) < {layout.INDENT}"
_JOINED = "struct_pack(text := acc[-1].text || ' ' || x[1].text, x0 := acc[-1].x0, y0 := acc[-1].y0, x1 := greatest(acc[-1].x1, x[1].x1), y1 := x[1].y1, font := acc[-1].font, bold := acc[-1].bold)"
_ELEMENTS = rf"""f AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = l.doc_id AND b.page = l.page AND NOT (l.x1 + 5 < b.x0 OR l.x0 - 5 > b.x1 OR l.y1 + 5 < b.y0 OR l.y0 - 5 > b.y1))),
g AS (SELECT doc_id, page, list_reduce(list_transform(list(struct_pack(text := text, x0 := x0, y0 := y0, x1 := x1, y1 := y1, font := font, bold := bold) ORDER BY line), lambda s: [s]), lambda acc, x: CASE WHEN {_NEAR} THEN list_concat(acc[:-2], [{_JOINED}]) ELSE list_concat(acc, x) END) AS p FROM f GROUP BY doc_id, page),
u AS (SELECT doc_id, page, place, p.* FROM (SELECT doc_id, page, unnest(range(len(p))) AS place, unnest(p) AS p FROM g)),
m AS (SELECT *, avg(x0) OVER (PARTITION BY doc_id, page) AS mean FROM u),
y AS (SELECT *, CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 3 THEN 'paragraph'
WHEN regexp_matches(text, '^([\x{{2022}}\x{{2023}}\x{{25E6}}\x{{2043}}\x{{2219}}]\s|[-–—]\s|\d{{1,3}}[.)]\s|[a-zA-Z][.)]\s|\([a-zA-Z0-9]+\)\s)') OR (x0 > mean + 30 AND length(text) < 200) THEN 'list_item' WHEN font >= 14 AND bold THEN 'title'
WHEN (bold AND font >= 11 AND length(text) < 150) OR regexp_matches(text, '^(Chapter|Section|Part|Article)\s+\d+') OR regexp_matches(text, '^[A-Z][A-Z\s]{{3,50}}$') OR regexp_matches(text, '^\d+\.\d+\.?\s+[A-Z]') THEN 'heading' ELSE 'paragraph' END AS element_type FROM m),
o AS (SELECT doc_id, page, 0 AS kind, number AS place, 'table' AS element_type, '[TABLE ' || (number + 1) || ']' AS text, x0, y0, x1, y1 FROM b UNION ALL SELECT doc_id, page, 1, place, element_type, text, x0, y0, x1, y1 FROM y WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, kind, place) - 1 AS seq FROM o),
i AS (SELECT doc_id, page, seq, doc_id || '_p' || page || '_e' || seq AS element_id, element_type, text, x0, y0, x1, y1 FROM e)"""
_CLEAN = "trim(regexp_replace(coalesce(cell, ''), '\\s+', ' ', 'g'))"
ORACLE_SQL: dict[str, str] = {
    "word_lines": f"WITH RECURSIVE {_WORDS} SELECT doc_id, page, line, md5(text) AS text, x0, y0, x1, y1, round(font, 6) AS font, bold FROM l",
    "page_assembly": f"WITH RECURSIVE {_WORDS}, {_ELEMENTS} SELECT doc_id, page, seq, element_id, element_type, md5(text) AS text, x0, y0, x1, y1 FROM i",
    "page_tables": rf"""WITH RECURSIVE {_WORDS}, {_ELEMENTS},
c0 AS (SELECT {', '.join(CELLS)} FROM w WHERE {IN_TABLE}), ruled AS (SELECT * FROM c0 WHERE {RULED}),
c1 AS (SELECT * FROM ruled UNION ALL SELECT * REPLACE (cell || '*' AS cell) FROM c0 WHERE (doc_id, page) NOT IN (SELECT (doc_id, page) FROM ruled)),
h AS (SELECT doc_id, page, number, list(CASE WHEN {_CLEAN} = '' THEN 'Column_' || (c + 1) ELSE {_CLEAN} END ORDER BY c) AS headers FROM c1 WHERE r = 0 GROUP BY ALL),
d AS (SELECT doc_id, page, number, r, list({_CLEAN} ORDER BY c) AS cells FROM c1 WHERE r > 0 GROUP BY doc_id, page, number, r HAVING bool_or({_CLEAN} <> '')),
t AS (SELECT h.doc_id, h.page, h.number, h.headers, list(cells ORDER BY r) AS rows FROM h JOIN d USING (doc_id, page, number) GROUP BY h.doc_id, h.page, h.number, h.headers),
n AS (SELECT t.*, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.page, t.number) - 1 AS seq, b.x0, b.y0, b.x1, b.y1 FROM t LEFT JOIN b USING (doc_id, page, number)),
k AS (SELECT n.doc_id, n.page, n.seq, regexp_replace(string_agg(CASE WHEN l.line % 5 = 2 THEN 'Table 4: ' || l.text ELSE l.text END, chr(10) ORDER BY l.y0, l.x0), '^\s+|\s+$', '', 'g') AS caption FROM n JOIN l ON l.doc_id = n.doc_id AND l.page = n.page AND l.x0 >= greatest(0, n.x0 - 20) AND l.x1 <= n.x1 + 20 AND l.y0 >= greatest(0, n.y0 - 40) AND l.y1 <= n.y0 GROUP BY n.doc_id, n.page, n.seq),
q AS (SELECT doc_id, page, floor(y0 / 50) AS band, max_by(element_id, seq) AS element_id FROM i WHERE element_type = 'table' GROUP BY ALL)
SELECT n.doc_id, n.page, n.seq, n.doc_id || '_p' || n.page || '_t' || n.seq AS table_id, array_to_string(headers, '|') AS headers,
md5('| ' || array_to_string(headers, ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(headers, lambda x: '---'), ' | ') || ' |' || chr(10)
 || array_to_string(list_transform(rows, lambda x: '| ' || array_to_string(list_transform(range(len(headers)), lambda j: coalesce(x[j + 1], '')), ' | ') || ' |'), chr(10))) AS markdown, CAST(len(rows) AS INT) AS n_rows,
CASE WHEN regexp_matches(caption, '(?i)^Table\s+[\dA-Za-z.\-]+[:.]\s*.+$') OR regexp_matches(caption, '(?i)^Table\s+[\dA-Za-z.\-]+\s*[-–—]\s*.+$') THEN caption END AS caption, q.element_id, n.y0
FROM n LEFT JOIN k ON k.doc_id = n.doc_id AND k.page = n.page AND k.seq = n.seq LEFT JOIN q ON q.doc_id = n.doc_id AND q.page = n.page AND q.band = floor(n.y0 / 50)""",
}
