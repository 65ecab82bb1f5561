"""Pages from positioned words: lines, what lies outside tables, elements in order, and tables of cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.operators import chunks, layout

#: A word belongs to a line if its top is within this of the line's first word; a font is this where none is stated.
SAME_LINE, PLAIN_FONT = 5.0, 10.0


def word_lines(words: DataFrame, page: list[str], within: float = SAME_LINE, parts: int | None = None) -> DataFrame:
    """(page columns, line, text, x0, y0, x1, y1, font, bold) from words (page columns, seq, text, x0, top, x1, bottom, size, font_name).

    Words go by top, then x0, then seq. A line takes words as long as their top is within `within` of its first word's, so
    small steps down end a line that a comparison of neighbours would go on with. font is the mean of the stated sizes, bold
    says that a font's name has "bold" in it. Words without a top are on no line.

    The words of a page are gathered, and lines of many pages are found at once. A group is a page, and words that are dealt
    by page stay where they are. With parts the lines are dealt by page to so many partitions, a row a page, so that all who
    read them read the same: they are found once.
    """
    sized = F.when(F.coalesce("size", F.lit(0)) != 0, F.col("size")).cast("double").alias("size")
    bold = F.coalesce(F.lower("font_name").contains("bold"), F.lit(False)).alias("bold")
    word = F.struct(*[F.col(c).cast("double").alias(c) for c in ("top", "x0", "x1", "bottom")], sized, bold, "seq", "text")
    every = words.where(F.col("top").isNotNull()).groupBy(*page).agg(F.collect_list(word).alias("words"))
    found = F.arrow_udf(lambda lists: _lines(lists, within), LINES)
    sheets = every.select(*page, found("words").alias("lines"))
    lines = (sheets if parts is None else sheets.repartition(parts, *page)).select(*page, F.posexplode("lines").alias("line", "l")).select(*page, "l.*", "line")
    return lines.withColumn("text", F.trim("text"))


#: Of the lines of a page.
LINES = "array<struct<text string, x0 double, y0 double, x1 double, y1 double, font double, bold boolean>>"


def _lines(lists: pa.Array, within: float) -> pa.Array:
    """The lines of each list of words (top, x0, x1, bottom, size, bold, seq, text) in order."""
    n, length = len(lists), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    top, x0, x1, bottom, size, bold, seq, text = lists.flatten().flatten()
    page, tops = np.repeat(np.arange(n), length), top.to_numpy(zero_copy_only=False)
    keys = [tops, page]  # the last is the first to sort by
    for column in (x0, seq if pa.types.is_integer(seq.type) else pc.rank(seq, null_placement="at_start", tiebreaker="dense")):
        nulls = [column.is_valid().to_numpy(zero_copy_only=False)] if column.null_count else []  # they come first
        keys = [column.fill_null(0).to_numpy(zero_copy_only=False), *nulls, *keys]
    order = np.lexsort(keys)
    if len(order) > 1 and np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys]).any():
        order = np.lexsort([pc.rank(text, null_placement="at_start", tiebreaker="dense").to_numpy(), *keys])
    page, tops = page[order], tops[order]
    same = tops[1:] == tops[:-1]
    same |= np.isnan(tops[1:]) & np.isnan(tops[:-1])
    new = np.concatenate([np.ones(min(1, len(page)), bool), page[1:] != page[:-1]])
    other = np.flatnonzero(np.concatenate([new[:1], new[1:] | ~same]))
    begins, first = [], 0.0
    for at, fresh, value in zip(other.tolist(), new[other].tolist(), tops[other].tolist(), strict=True):
        if fresh or not value - first <= within:
            begins.append(at)
            first = value
    at = np.array(begins, np.int64)

    def extreme(column: pa.Array, of: np.ufunc, nothing: float) -> pa.Array:
        if not column.null_count:
            return pa.array(of.reduceat(column.to_numpy(zero_copy_only=False)[order], at))
        valid = column.is_valid().to_numpy(zero_copy_only=False)[order]
        return pa.array(of.reduceat(np.where(valid, column.to_numpy(zero_copy_only=False)[order], nothing), at), mask=~np.logical_or.reduceat(valid, at))

    if not len(at):
        return pa.array([[] for _ in range(n)], pa.list_(_LINE))
    stated = size.is_valid().to_numpy(zero_copy_only=False)[order]
    many = np.add.reduceat(stated, at, dtype=np.int64)
    font = np.where(many > 0, np.add.reduceat(np.where(stated, size.fill_null(0).to_numpy(zero_copy_only=False)[order], 0.0), at) / np.maximum(many, 1), PLAIN_FONT)
    told = text.take(pa.array(order))
    each = np.add.reduceat(told.is_valid().to_numpy(zero_copy_only=False), at, dtype=np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(each)).astype(np.int32)), told.drop_null()), " ")
    columns = [
        joined, extreme(x0, np.fmin, np.nan), pa.array(tops[at]), extreme(x1, np.maximum, -np.inf), extreme(bottom, np.maximum, -np.inf),
        pa.array(font), pa.array(np.logical_or.reduceat(bold.to_numpy(zero_copy_only=False)[order], at)),
    ]
    ends = np.searchsorted(page[at], np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, _LINE, strict=True)], fields=list(_LINE)))


_LINE = pa.struct([("text", pa.string()), *[(c, pa.float64()) for c in ("x0", "y0", "x1", "y1", "font")], ("bold", pa.bool_())])


def outside_boxes(lines: DataFrame, boxes: DataFrame, page: list[str], margin: float = 5) -> DataFrame:
    """The lines (page columns, line, x0, y0, x1, y1) that no box (page columns, x0, y0, x1, y1) of their page overlaps or comes within the margin of.

    The lines and boxes of one page meet, and a line goes at the first box that is near.
    """
    corners = ("x0", "y0", "x1", "y1")
    box = boxes.select(*[F.col(c).alias(f"_{c}") for c in page], F.struct(*corners).alias("_b"))
    near = layout.overlapping(F.struct(*corners), F.col("_b"), margin)
    return lines.join(box, [*[F.col(c) == F.col(f"_{c}") for c in page], near], "left_anti")


def numbered(rows: DataFrame, doc: str, page: str, order: list[str], name: str) -> DataFrame:
    """rows with their place in the document, from 0: by page, within a page by order.

    Pages are numbered by their rows, documents by the sums over their pages, so no task sorts a whole document.
    """
    sizes = rows.groupBy(doc, page).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(doc, page).orderBy(*order)) - 1
    joined = rows.withColumn("_place", place).join(sizes.select(doc, page, before.alias("_before")), [doc, page])
    return joined.withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_place", "_before")


def page_elements(lines: DataFrame, boxes: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, page, seq, element_id, element_type, text, x0, y0, x1, y1) of each page: its tables in order of their number, then its paragraphs.

    lines as of word_lines(), boxes (doc, page, number, x0, y0, x1, y1). Lines that a box overlaps are left out before
    paragraphs are made; blank paragraphs count when indents are compared and are then left out. seq numbers the elements of
    a document. A page without lines has its tables, one without tables its paragraphs.
    """
    at, corners = [doc, page], ["x0", "y0", "x1", "y1"]
    free = outside_boxes(lines, boxes, at).withColumnRenamed("line", "seq")
    blocks = layout.element_types(layout.paragraphs(free, at), at)
    shown = blocks.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select(*at, F.lit(1).alias("_kind"), "place", "element_type", "text", *corners)
    label = F.concat(F.lit("[TABLE "), (F.col("number") + 1).cast("string"), F.lit("]"))
    held = boxes.select(*at, F.lit(0).alias("_kind"), F.col("number").cast("int").alias("place"), F.lit("table").alias("element_type"), label.alias("text"), *corners)
    found = numbered(held.unionByName(shown), doc, page, ["_kind", "place"], "seq")
    return found.withColumn("element_id", F.format_string("%s_p%d_e%d", F.col(doc).cast("string"), page, "seq")).select(*at, "seq", "element_id", "element_type", "text", *corners)


def page_tables(ruled: DataFrame, aligned: DataFrame, boxes: DataFrame, elements: DataFrame, lines: DataFrame, doc: str, page: str) -> DataFrame:
    """S3: (doc, page, seq, table_id, headers, rows, caption, element_id, x0, y0, x1, y1) of the tables (doc, page, number, cells).

    A page's tables are those found by its ruled lines; by aligned text only where no ruled one was found. Tables of fewer than
    two rows, and those whose cells below the header are all blank, are left out. A table has the box of its number, if
    there is one, and by that its caption and the element of its band; seq numbers the kept tables of a document.
    """
    at = [doc, page]
    second = aligned.join(ruled.select(*at).distinct(), at, "left_anti")
    given = ruled.unionByName(second).where(F.size("cells") >= 2)
    read = given.select(*at, "number", chunks.headers(F.get("cells", F.lit(0))).alias("headers"), chunks.cells(F.slice("cells", 2, F.size("cells"))).alias("rows"))
    kept = numbered(read.where((F.size("headers") > 0) & (F.size("rows") > 0)), doc, page, ["number"], "seq")
    kept = kept.withColumn("table_id", F.format_string("%s_p%d_t%d", F.col(doc).cast("string"), page, "seq")).join(boxes.select(*at, "number", "x0", "y0", "x1", "y1"), [*at, "number"], "left").drop("number")
    boxed = kept.where("y0 IS NOT NULL").select(*at, "table_id", "x0", "y0", "x1", "y1")
    told = layout.captioned(boxed, lines.select(*at, "text", "x0", "y0", "x1", "y1"), at).select(*at, "table_id", "caption")
    tied = layout.placed_tables(boxed, elements.where("element_type = 'table'").select(*at, "seq", "element_id", "y0"), at).select(*at, "table_id", "element_id")
    out = kept.join(told, [*at, "table_id"], "left").join(tied, [*at, "table_id"], "left")
    return out.select(*at, "seq", "table_id", "headers", "rows", "caption", "element_id", "x0", "y0", "x1", "y1")
