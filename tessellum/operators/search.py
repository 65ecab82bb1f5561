"""Lexical index, exact vector search, and their fusion."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.text import simple_tokens
from tessellum.operators import chunks

#: Rows of one side of a tile of vectors.
TILE_QUERIES, TILE_ROWS = 1024, 8192


#: Different terms of all queries that are broadcast; more are joined by a shuffle.
ASKED = 100_000


def tokenized(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tokens) of each chunk. Those without a token don't count in the index."""
    return chunks.select(F.col(id_col).alias("id"), simple_tokens(F.col(text_col)).alias("tokens"))


def term_stats(tokens: DataFrame) -> DataFrame:
    """(term, df, cf): chunks that hold each term, and its places. Both are summed up in the map tasks first."""
    part = lambda terms, df: F.struct(terms.alias("terms"), F.lit(df).alias("df"), F.lit(1 - df).alias("cf"))
    parts = tokens.select(F.explode(F.array(part(F.array_distinct("tokens"), 1), part(F.col("tokens"), 0))).alias("p"))
    return parts.select(F.explode("p.terms").alias("term"), "p.df", "p.cf").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def bm25(tokens: DataFrame, queries: DataFrame, *, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """R2: (query_id, id, score) of the chunks (id, tokens) that hold a term of (query_id, text).

    idf = ln(N - df + 0.5) - ln(df + 0.5), a negative one is epsilon times the mean over all terms; a term that a
    query repeats counts as often. Chunks are read twice: for the terms' sums, and for the terms asked for, which meet
    them where they stand if they are at most ASKED.
    """
    # the term '' stands in every chunk, and brings the number and length of all
    once = tokens.select(F.size("tokens").alias("dl"), F.explode(F.when(F.size("tokens") > 0, F.concat(F.array_distinct("tokens"), F.array(F.lit(""))))).alias("term"))
    stats = once.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl"))
    corpus = F.max(F.when(F.col("term") == "", F.struct(F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))))
    asked = queries.select("query_id", F.explode(simple_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    many = asked.select("term").distinct().count()
    small = (lambda df: F.broadcast(df)) if many <= ASKED else (lambda df: df)
    # n is known only with all terms, so the sums are gathered by df: as many rows as there are different ones
    wanted = stats.join(small(asked.select(F.col("term").alias("t")).distinct()), F.col("term") == F.col("t"), "left")
    spread = wanted.groupBy("df").agg(F.count_if(F.col("term") != "").alias("terms"), F.collect_list(F.when(F.col("t").isNotNull(), F.col("term"))).alias("asked"), corpus.alias("c"))
    spread = spread.withColumn("c", F.max("c").over(Window.partitionBy())).withColumn("idf", F.log(F.col("c.n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = F.sum(F.when(F.col("terms") > 0, F.col("idf") * F.col("terms"))).over(Window.partitionBy()) / F.sum("terms").over(Window.partitionBy())
    idf = spread.withColumn("idf", F.when(F.col("idf") < 0, mean * epsilon).otherwise(F.col("idf"))).select("idf", F.col("c.avgdl").alias("avgdl"), F.explode("asked").alias("term"))
    weighed = asked.join(small(idf), "term")
    each = tokens.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(small(asked.select("term").distinct()), "term", "left_semi")
    found = each.groupBy("id", "term", "dl").agg(F.count("*").alias("tf")).join(small(weighed), "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return found.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int, *, positive: bool = False) -> DataFrame:
    """The k best of each query, ties by id; with positive, those of a score above 0, dropped after the cut. Adds rank."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    best = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.where("score > 0") if positive else best


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the k largest inner products of (query_id, vector) with (id, vector), ties by id, at any sign.

    A null vector, one with a null in it, or of another length than the first of `vectors` by id that is not null or empty,
    is no vector. Queries and rows meet in tiles; each tile gives k candidates a query.
    """
    whole = lambda v: v.isNotNull() & ~F.exists(v, lambda x: x.isNull())
    vectors, queries = vectors.where(whole(F.col("vector"))), queries.where(whole(F.col("vector")))
    width = vectors.where(F.size("vector") > 0).agg(F.min_by(F.size("vector"), "id")).first()[0] or 0
    vectors, queries = vectors.where(F.size("vector") == width), queries.where(F.size("vector") == width)
    n_queries, n = queries.count(), vectors.count()
    blocks, groups = max(1, math.ceil(n_queries / TILE_QUERIES)), max(1, math.ceil(n / TILE_ROWS))
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    part = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    vector = F.col("vector").cast("array<double>").alias("vector")
    left = queries.select(part("query_id", blocks).alias("block"), spread(groups).alias("group"), F.lit(True).alias("query"), F.col("query_id").cast("long").alias("id"), vector)
    right = vectors.select(spread(blocks).alias("block"), part("id", groups).alias("group"), F.lit(False).alias("query"), F.col("id").cast("long").alias("id"), vector)

    def run(tile: pa.Table) -> pa.Table:
        query, ids = tile["query"].to_numpy(), tile["id"].to_numpy()
        x = tile["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        scores = x[query] @ x[~query].T
        rows = ids[~query]
        best = [np.lexsort((rows, -s))[:k] for s in scores]
        sizes = [len(b) for b in best]
        at = np.concatenate([np.zeros(0, np.int64), *best]).astype(np.int64)
        q = np.repeat(np.arange(len(best)), sizes)
        return pa.table({"query_id": ids[query][q], "id": rows[at], "score": scores[q, at]})

    tiles = left.unionByName(right).groupBy("block", "group").applyInArrow(run, "query_id long, id long, score double")
    return top_k(tiles, k)


def by_max(scores: DataFrame) -> DataFrame:
    """Each query's scores divided by its largest; all 0 if that is 0."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return scores.withColumn("score", F.when(best == 0, 0.0).otherwise(F.col("score") / best))


def hybrid(lexical: DataFrame, vector: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """The top 2k of each, divided by their largest, weighed and added, a missing one as 0; top k, ties by id."""
    a = by_max(top_k(lexical, 2 * k, positive=True)).select("query_id", "id", F.col("score").alias("lexical"))
    b = by_max(top_k(vector, 2 * k)).select("query_id", "id", F.col("score").alias("vector"))
    both = a.join(b, ["query_id", "id"], "full_outer")
    score = F.coalesce("lexical", F.lit(0.0)) * weight + F.coalesce("vector", F.lit(0.0)) * (1 - weight)
    return top_k(both.select("query_id", "id", score.alias("score")), k)


def expand(hits: DataFrame, chunks: DataFrame, id_col: str) -> DataFrame:
    """Hits with their chunk's columns; ids that no chunk has are dropped."""
    return hits.join(chunks.withColumnRenamed(id_col, "id"), "id")


def unit(vector: Column) -> Column:
    """A vector at length 1; null if it has no length."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length))


def is_table_hit() -> Column:
    """A chunk (chunk_type, table_id) is the summary of a table."""
    return F.coalesce((F.col("chunk_type") == "table_summary") & F.col("table_id").isNotNull(), F.lit(False))


def with_tables(hits: DataFrame, tables: DataFrame) -> DataFrame:
    """Chunks or hits (doc_id, table_id, ...) with the markdown of their table (doc_id, table_id, headers, rows), null without one."""
    shown = tables.select("doc_id", "table_id", chunks.markdown(chunks.headers(F.col("headers")), chunks.cells(F.col("rows"))).alias("markdown"))
    return hits.join(shown, ["doc_id", "table_id"], "left")
