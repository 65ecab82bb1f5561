"""Elements to overlapping chunks, and tables to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.text import blank_tokens


def windows(elements: DataFrame, id_col: str, text_col: str, size: int = 400, overlap: int = 80) -> DataFrame:
    """I8: (id, chunk, n_tokens, text): sliding windows over each text's tokens; blank texts have none. overlap < size."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    tokens = elements.select(F.col(id_col).alias("id"), blank_tokens(F.col(text_col)).alias("tokens")).where(F.size("tokens") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("tokens") - size) / step).cast("int"))
    each = tokens.select("id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    part = F.slice("tokens", F.col("chunk") * step + 1, F.lit(size))
    return each.select("id", "chunk", F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("text"))


def document_windows(elements: DataFrame, size: int = 400, overlap: int = 80) -> DataFrame:
    """(doc_id, chunk, n_tokens, text, first_page, last_page, element_ids): windows over each document's elements (doc_id, seq, page, element_id, text) in order of seq.

    A chunk's elements are the last one of the chunk before and those that give it new tokens; its pages are theirs,
    with the greatest page so far for the chunk before. Blank and null elements give nothing. Each element is cut into
    its chunks where it is: no document is put together, and one group is the tokens of one chunk. overlap < size.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    order = Window.partitionBy("doc_id").orderBy("seq")
    cut = elements.select("doc_id", "seq", "page", "element_id", blank_tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    cut = cut.withColumn("b", F.sum(F.size("tokens")).over(order)).withColumn("a", F.col("b") - F.size("tokens"))
    cut = cut.withColumn("n", F.sum(F.size("tokens")).over(Window.partitionBy("doc_id")))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step))
    first = F.greatest(F.lit(0), F.ceil((F.col("a") - size + 1) / step))
    each = cut.withColumn("chunk", F.explode(F.sequence(first, F.least(F.floor((F.col("b") - 1) / step), last)))).withColumn("chunk", F.col("chunk").cast("int"))
    low = F.greatest(F.col("a"), F.col("chunk") * step)
    part = F.slice("tokens", (low - F.col("a") + 1).cast("int"), (F.least(F.col("b"), F.col("chunk") * step + size) - low).cast("int"))
    new = (F.col("chunk") == 0) | (F.col("b") > F.col("chunk") * step + overlap)
    pieces = F.array_sort(F.collect_list(F.struct("seq", "element_id", new.alias("new"), part.alias("part"))))
    found = each.groupBy("doc_id", "chunk").agg(pieces.alias("p"), F.min(F.when(new, F.col("page"))).alias("low"), F.max(F.when(new, F.col("page"))).alias("high"))
    tokens = F.flatten(F.transform("p", lambda x: x["part"]))
    by_chunk = Window.partitionBy("doc_id").orderBy("chunk")
    before = F.max("high").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1))
    carried = F.lag(F.element_at("p", -1)["element_id"]).over(by_chunk)
    named = F.transform(F.filter("p", lambda x: x["new"]), lambda x: x["element_id"])
    ids = F.array_distinct(F.filter(F.concat(F.array(carried), named), lambda i: i.isNotNull()))
    return found.select(
        "doc_id", "chunk", F.size(tokens).alias("n_tokens"), F.array_join(tokens, " ").alias("text"),
        F.least(before, "low").alias("first_page"), F.greatest(before, "high").alias("last_page"), ids.alias("element_ids"),
    )


def headers(raw: Column) -> Column:
    """I4: white space collapsed, blank headers named Column_i from 1."""
    clean = F.transform(raw, lambda h: F.trim(F.regexp_replace(F.coalesce(h, F.lit("")), r"\s+", " ")))
    return F.transform(clean, lambda h, i: F.when(h == "", F.concat(F.lit("Column_"), (i + 1).cast("string"))).otherwise(h))


def cells(rows: Column) -> Column:
    """Null cells empty, white space collapsed, rows of empty cells dropped."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    return F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))


def markdown(head: Column, rows: Column) -> Column:
    """Short rows padded and long ones cut to the header's width."""
    line = lambda x: F.concat(F.lit("| "), F.array_join(x, " | "), F.lit(" |"))
    fit = lambda r: F.transform(head, lambda h, i: F.coalesce(F.get(r, i), F.lit("")))
    rule = line(F.transform(head, lambda h: F.lit("---")))
    return F.array_join(F.concat(F.array(line(head), rule), F.transform(rows, lambda r: line(fit(r)))), "\n")


def surrogate(caption: Column, head: Column, rows: Column, shown: int = 3) -> Column:
    """Caption, columns, the first rows with their non-empty cells, and the number of rows if more."""
    row = lambda r: F.array_join(F.filter(r, lambda c: c != ""), ", ")
    parts = F.concat(
        F.when(F.coalesce(caption, F.lit("")) != "", F.array(F.concat(F.lit("Table: "), caption))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("Columns: "), F.array_join(head, ", "))),
        F.transform(F.slice(rows, 1, shown), row),
        F.when(F.size(rows) > shown, F.array(F.concat(F.lit("Total rows: "), F.size(rows).cast("string")))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_join(parts, "\n")
