"""Lines to paragraphs, and headings to section paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What still joins a line to a paragraph: gap below it, difference of font size, difference of indent.
GAP, FONT, INDENT = 15.0, 1.5, 50.0
HEADINGS = ("title", "heading")
#: Starts of list items, and texts that are headings whatever their font.
LIST_STARTS = (r"[\u2022\u2023\u25E6\u2043\u2219]\s", r"[-–—]\s", r"\d{1,3}[.)]\s", r"[a-zA-Z][.)]\s", r"\([a-zA-Z0-9]+\)\s")
HEADING_TEXTS = (r"^(Chapter|Section|Part|Article)\s+\d+", r"^[A-Z][A-Z\s]{3,50}$", r"^\d+\.\d+\.?\s+[A-Z]")
CAPTIONS = (r"(?i)^Table\s+[\dA-Za-z.\-]+[:.]\s*.+$", r"(?i)^Table\s+[\dA-Za-z.\-]+\s*[-–—]\s*.+$")


def paragraphs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, text, x0, y0, x1, y1, font) from lines (keys, seq, text, x0, y0, x1, y1, font), in order of seq.

    A line joins the running paragraph, whose indent and font, and bold if lines have it, are those of its first line and
    whose end is that of its last, so it is an ordered fold. keys should name a page: one group is the lines of one page.
    """
    first = ["font", *[c for c in lines.columns if c == "bold"]]
    fields = ("text", "x0", "y0", "x1", "y1", *first)
    ordered = F.array_sort(F.collect_list(F.struct("seq", *fields)))
    page = lines.groupBy(*keys).agg(F.transform(ordered, lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("lines"))

    def step(done: Column, line: Column) -> Column:
        last = F.element_at(done, -1)
        near = (line["y0"] - last["y1"] < GAP) & (F.abs(line["font"] - last["font"]) < FONT) & (F.abs(line["x0"] - last["x0"]) < INDENT)
        joined = F.struct(
            F.concat(last["text"], F.lit(" "), line["text"]).alias("text"), last["x0"].alias("x0"), last["y0"].alias("y0"),
            F.greatest(last["x1"], line["x1"]).alias("x1"), line["y1"].alias("y1"), *[last[c].alias(c) for c in first],
        )
        return F.when(near, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(line)))

    rest = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    folded = page.select(*keys, F.aggregate(rest, F.slice("lines", 1, 1), step).alias("found"))
    return folded.select(*keys, F.posexplode("found").alias("place", "p")).select(*keys, "place", "p.*")


def section_paths(elements: DataFrame, id_col: str) -> DataFrame:
    """Elements (id, seq, element_type, text, ...) with path: the last three of the latest title and the headings after it.

    All windows lie within one document and are sorted alike by one shuffle; no list grows with the document.
    """
    order = Window.partitionBy(id_col).orderBy("seq")
    head = F.col("element_type").isin(*HEADINGS)
    marked = elements.withColumn("_head", head).withColumn("_epoch", F.sum((F.col("element_type") == "title").cast("int")).over(order))
    among = Window.partitionBy(id_col, "_epoch", "_head").orderBy("seq")
    latest = F.filter(F.array(F.lag("text", 2).over(among), F.lag("text", 1).over(among), F.col("text")), lambda t: t.isNotNull())
    pathed = marked.withColumn("_path", F.when(F.col("_head"), latest))
    path = F.coalesce(F.last("_path", ignorenulls=True).over(order), F.array().cast("array<string>"))
    return pathed.withColumn("path", path).drop("_head", "_epoch", "_path")


def interleaved(text_chunks: DataFrame, table_chunks: DataFrame) -> DataFrame:
    """Both kinds of chunk (doc_id, chunk_id, start, ...) with their place in a document: by first page, text first, then id as text."""
    both = text_chunks.withColumn("chunk_type", F.lit("text")).unionByName(table_chunks.withColumn("chunk_type", F.lit("table_summary")))
    order = Window.partitionBy("doc_id").orderBy("start", (F.col("chunk_type") != "text").cast("int"), F.col("chunk_id").cast("string"))
    return both.withColumn("place", F.row_number().over(order))


def element_types(blocks: DataFrame, page: list[str]) -> DataFrame:
    """Blocks (page columns, text, x0, font, bold) with element_type: title, heading, list_item or paragraph.

    Rules in order: short texts are paragraphs; list starts, then indents by over 30 against the page's mean, are list
    items; then titles and headings by font, headings by text. Null text counts as empty.
    """
    text = F.coalesce("text", F.lit(""))
    size = F.length(text)
    indented = F.col("x0") > F.avg("x0").over(Window.partitionBy(*page)) + 30
    kind = (
        F.when(F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) < 3, "paragraph")
        .when(text.rlike(f"^({'|'.join(LIST_STARTS)})") | (indented & (size < 200)), "list_item")
        .when((F.col("font") >= 14) & F.col("bold"), "title")
        .when(F.col("bold") & (F.col("font") >= 11) & (size < 150), "heading")
        .when(text.rlike("|".join(HEADING_TEXTS)), "heading")
        .otherwise("paragraph")
    )
    return blocks.withColumn("element_type", kind)


def overlapping(a: Column, b: Column, margin: float = 5) -> Column:
    """Boxes (x0, y0, x1, y1) overlap or come within the margin; touching counts."""
    return (a["x1"] + margin >= b["x0"]) & (a["x0"] - margin <= b["x1"]) & (a["y1"] + margin >= b["y0"]) & (a["y0"] - margin <= b["y1"])


def captioned(tables: DataFrame, lines: DataFrame, page: list[str]) -> DataFrame:
    """Tables (page columns, table_id, x0, y0, x1, y1) with caption: the text of the lines wholly in the 40 units above, 20 wider on both sides, if it reads like one.

    Tables and lines of one page meet, so a group is a page; lines are joined by newlines in order of y0 and x0.
    """
    at = tables.select(*page, "table_id", F.greatest(F.lit(0.0), F.col("x0") - 20).alias("a0"), F.greatest(F.lit(0.0), F.col("y0") - 40).alias("b0"), (F.col("x1") + 20).alias("a1"), F.col("y0").alias("b1"))
    above = lines.join(at, page).where("x0 >= a0 AND x1 <= a1 AND y0 >= b0 AND y1 <= b1")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda s: s["text"]), "\n")
    whole = above.groupBy(*page, "table_id").agg(F.regexp_replace(text, r"^\s+|\s+$", "").alias("caption"))
    fits = F.col("caption").rlike("|".join(CAPTIONS))
    return tables.join(whole.where(fits), [*page, "table_id"], "left")


def placed_tables(tables: DataFrame, elements: DataFrame, page: list[str]) -> DataFrame:
    """Tables (page columns, table_id, y0) with element_id: the last element (page columns, seq, element_id, y0) of the same band of 50 units."""
    band = F.floor(F.col("y0") / 50).alias("_band")
    last = elements.groupBy(*page, band).agg(F.max_by("element_id", "seq").alias("element_id"))
    return tables.select("*", band).join(last, [*page, "_band"], "left").drop("_band")
