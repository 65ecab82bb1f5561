"""Queries over the lexical index, vectors and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.functions import text
from tessellum.operators import chunks, search
from tessellum.sources import index, state, tables

K = 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text asks all documents."""
    docs = _table(spark, sf_dir, "documents")
    scores = search.bm25(search.tokenized(_documents(spark, sf_dir), "doc_id", "text"), _asked(spark, sf_dir))
    hits = search.top_k(scores.withColumn("score", F.round("score", 9)), K, positive=True)
    return _rounded(search.expand(hits, docs.select("doc_id", "lang", "source"), "doc_id"))


def bm25_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index that is written, loaded and asked."""
    folder = state.scratch(spark, "index")
    index.build(search.tokenized(_documents(spark, sf_dir), "doc_id", "text"), folder)
    held = index.load(spark, folder)
    scores = held.bm25(_asked(spark, sf_dir))
    hits = search.top_k(scores.withColumn("score", F.round("score", 9)), K, positive=True)
    return _rounded(search.expand(hits, _table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id"))


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and different tokens of each document."""
    t = text.simple_tokens(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_terms"))


def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and corpus frequency of each term."""
    return search.term_stats(search.tokenized(_documents(spark, sf_dir), "doc_id", "text"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 20 ask all vectors."""
    vectors = _vectors(spark, sf_dir)
    asked = vectors.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    return _rounded(search.vector_top_k(vectors, asked, K))


def vector_label_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label's queries, the share of hits with that label."""
    labels = _table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = vector_topk(spark, sf_dir).join(labels.withColumnsRenamed({"vec_id": "query_id", "label": "asked"}), "query_id")
    hits = hits.join(labels.withColumnRenamed("vec_id", "id"), "id")
    return hits.groupBy("asked").agg(F.count("*").alias("hits"), F.round(F.avg((F.col("label") == F.col("asked")).cast("double")), 6).alias("share"))


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text and the vector of its number ask documents and the vectors of their ids."""
    lexical = search.bm25(search.tokenized(_documents(spark, sf_dir), "doc_id", "text"), _asked(spark, sf_dir)).withColumn("score", F.round("score", 9))
    vectors = _vectors(spark, sf_dir)
    asked = vectors.join(_asked(spark, sf_dir).select(F.col("query_id").alias("id")), "id").withColumnRenamed("id", "query_id")
    near = search.vector_top_k(vectors, asked, 2 * K).drop("rank").withColumn("score", F.round("score", 9))
    return search.hybrid(lexical, near, K).withColumn("score", F.round("score", 6)).drop("rank")


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8: windows of 400 tokens, 80 shared."""
    return chunks.windows(_documents(spark, sf_dir), "doc_id", "text").withColumnRenamed("id", "doc_id")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation")
    row = F.array(F.col("n_nationkey").cast("string"), F.concat(F.lit("  "), F.col("n_name"), F.lit(" ")))
    tables = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))).alias("r"))
    tables = tables.join(_table(spark, sf_dir, "region"), tables["n_regionkey"] == F.col("r_regionkey"))
    head = chunks.headers(F.array(F.lit("key"), F.lit(" "), F.lit("note")))
    return tables.select(F.col("n_regionkey").alias("table_id"), F.col("r_name").alias("caption"), head.alias("head"), chunks.cells(F.transform("r", lambda x: x["row"])).alias("rows"))


def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's nations as a table."""
    return _nations(spark, sf_dir).select("table_id", F.size("rows").alias("n_rows"), chunks.markdown(F.col("head"), F.col("rows")).alias("markdown"))


def table_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I12 I13."""
    return _nations(spark, sf_dir).select("table_id", chunks.surrogate(F.col("caption"), F.col("head"), F.col("rows")).alias("text"))


def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16: ids made of page addresses."""
    return _table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (bm25_topk, bm25_stored, token_stats, doc_freq, vector_topk, vector_label_share, hybrid_topk, chunk_windows, table_markdown, table_surrogate, doc_ids)
}

_TOKENS = r"list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z][a-zA-Z0-9]+')), lambda w: lower(w))"
_BM25 = f"""
tok AS (SELECT doc_id AS id, {_TOKENS} AS t FROM documents),
p AS (SELECT id, term, len(t) AS dl, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM tok) GROUP BY ALL),
c AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok WHERE len(t) > 0),
d AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p, c GROUP BY term, n),
i AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM d) ELSE idf END AS idf FROM d),
a AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM a JOIN i USING (term) JOIN p USING (term), c GROUP BY ALL)
"""
_DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"
_VECTOR = f"""
v AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_DOT} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
vt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v) WHERE rank <= 10)
"""
_NATIONS = """
t AS (SELECT n_regionkey AS table_id, r_name AS caption, list([CAST(n_nationkey AS VARCHAR), n_name] ORDER BY n_nationkey) AS r FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
"""
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"
ORACLE_SQL: dict[str, str] = {
    "bm25_topk": f"""WITH {_BM25} SELECT query_id, id, round(score, 6) AS score, rank, lang, source
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) JOIN documents ON id = doc_id WHERE rank <= 10 AND score > 0""",
    "token_stats": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)",
    "doc_freq": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term",
    "vector_topk": f"WITH {_VECTOR} SELECT query_id, id, round(score, 6) AS score, rank FROM vt",
    "vector_label_share": f"""WITH {_VECTOR} SELECT q.label AS asked, count(*) AS hits, round(avg(CAST(q.label = e.label AS INT)), 6) AS share
FROM vt JOIN embeddings q ON q.vec_id = query_id JOIN embeddings e ON e.vec_id = id GROUP BY q.label""",
    "hybrid_topk": f"""WITH {_BM25},
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 20 AND score > 0),
l1 AS (SELECT query_id, id, score / max(score) OVER (PARTITION BY query_id) AS x FROM l),
v AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_DOT}, 9) AS score FROM embeddings q JOIN benchmark b ON q.vec_id = b.item_id, embeddings e),
v1 AS (SELECT query_id, id, score / max(score) OVER (PARTITION BY query_id) AS y FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM v) WHERE r <= 20),
h AS (SELECT query_id, id, coalesce(x, 0) * 0.5 + coalesce(y, 0) * 0.5 AS score FROM l1 FULL JOIN v1 USING (query_id, id))
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM h) WHERE r <= 10""",
    "chunk_windows": f"""WITH w AS (SELECT doc_id, {_WORDS} AS t FROM documents),
c AS (SELECT doc_id, t, unnest(range(0, 1 + greatest(0, CAST(ceil((len(t) - 400) / 320) AS BIGINT)))) AS k FROM w WHERE len(t) > 0)
SELECT doc_id, k AS chunk, len(t[k * 320 + 1 : k * 320 + 400]) AS n_tokens, array_to_string(t[k * 320 + 1 : k * 320 + 400], ' ') AS text FROM c""",
    "table_markdown": f"""WITH {_NATIONS} SELECT table_id, len(r) AS n_rows,
'| key | Column_2 | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(list_transform(r, lambda x: '| ' || x[1] || ' | ' || x[2] || ' |  |'), chr(10)) AS markdown FROM t""",
    "table_surrogate": f"""WITH {_NATIONS} SELECT table_id, 'Table: ' || caption || chr(10) || 'Columns: key, Column_2, note' || chr(10) || array_to_string(list_transform(r[1:3], lambda x: x[1] || ', ' || x[2]), chr(10))
|| CASE WHEN len(r) > 3 THEN chr(10) || 'Total rows: ' || len(r) ELSE '' END AS text FROM t""",
    "doc_ids": "SELECT page_id, upper(substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9]', '_', 'g'), '^_+|_+$', '', 'g'), 1, 30)) AS slug FROM pages",
}
ORACLE_SQL["bm25_stored"] = ORACLE_SQL["bm25_topk"]
