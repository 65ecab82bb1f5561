"""A lexical index as Parquet: postings and terms by buckets of terms, and one row of the corpus; asked without its texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellum.functions.text import simple_tokens
from tessellum.operators.search import ASKED
from tessellum.sources.files import load_index


#: Texts whose terms are counted in one go.
TEXTS = 1000
#: Bucket of the rows that stand for whole texts.
WHOLE = -1


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    """Postings (term, id, tf, dl, bucket), terms (term, df, bucket), and of the corpus n, avgdl, mean_idf and buckets."""

    postings: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    mean_idf: float
    buckets: int

    def bm25(self, queries: DataFrame, *, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
        """R2: (query_id, id, score) as search.bm25() over the texts; only buckets of terms asked for are read.

        At most ASKED terms are numbered, and the postings that have one are dealt by id before they meet the queries, so
        that a text's scores are summed up where it is and each posting is moved once, however many queries ask for it.
        """
        asked = queries.select("query_id", F.explode(simple_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        asked = asked.withColumn("bucket", _bucket(F.col("term"), self.buckets))
        # at most as many rows as there are buckets
        read = [r[0] for r in asked.select("bucket").distinct().collect()]
        of_bucket = F.col("bucket").isin(read)
        idf = F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        weigh = lambda known, *more: known.select("term", "query_id", "times", F.when(idf < 0, self.mean_idf * epsilon).otherwise(idf).alias("idf"), *more)
        terms, postings = self.terms.where(of_bucket), self.postings.where(of_bucket)
        different = asked.select("term").distinct()
        if different.count() <= ASKED:
            number = different.withColumn("number", F.row_number().over(Window.orderBy("term")))
            weighed = weigh(terms.join(F.broadcast(asked.drop("bucket").join(number, "term")), "term"), "number").drop("term")
            dealt = postings.join(F.broadcast(number), "term").select("id", "number", "tf", "dl").repartition("id")
            found = dealt.join(F.broadcast(weighed), "number")
        else:
            found = postings.join(weigh(terms.join(asked.drop("bucket"), "term")), "term")
        part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / self.avgdl))
        return found.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def _counted(tokens: DataFrame) -> DataFrame:
    """(id, dl, term, tf) of (id, tokens), terms together as they come; the term '' stands once for each text. Rows with an id of their own are counted where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                ids, lists = whole.slice(at, TEXTS).columns
                n, size = len(ids), pc.list_value_length(lists).to_numpy().astype(np.int64)
                held = lists.flatten().dictionary_encode()
                key = held.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), size)
                key, tf = np.unique(key, return_counts=True)
                row = np.concatenate([key % n, np.arange(n)])
                term = pa.concat_arrays([held.dictionary.take(pa.array(key // n)), pa.array([""] * n, held.dictionary.type)])
                columns = [ids.take(pa.array(row)), pa.array(size[row].astype(np.int32)), term, pa.array(np.concatenate([tf, np.ones(n, np.int64)]).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "dl", "term", "tf"])

    kind = T.StructType([T.StructField("id", tokens.schema["id"].dataType), *T._parse_datatype_string("dl int, term string, tf long").fields])
    some = tokens.where(F.size("tokens") > 0).select("id", "tokens")
    # the ids alone are read for this
    repeated = tokens.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("id").alias("again"))
    if repeated.isEmpty():
        return some.mapInArrow(run, kind)
    same = F.col("id").eqNullSafe(F.col("again"))
    each = some.join(repeated, same, "left_semi").select("id", F.size("tokens").alias("dl"), F.explode(F.concat("tokens", F.array(F.lit("")))).alias("term"))
    apart = some.join(repeated, same, "left_anti").mapInArrow(run, kind)
    return apart.unionByName(each.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")))


def build(tokens: DataFrame, path: str, buckets: int = 64) -> None:
    """Writes the index of (id, tokens) below path; the corpus comes last, so an index that was cut short is none.

    Postings are written by the tasks that count them, a file a bucket and task: texts are read once and none is moved, but
    rows of one id and length, which are one text, are put together. A text is also a row of the bucket WHOLE, from which
    the corpus comes.
    """
    counted = _counted(tokens).withColumn("bucket", F.when(F.col("term") == "", WHOLE).otherwise(_bucket(F.col("term"), buckets)))
    counted.sortWithinPartitions("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    spark = tokens.sparkSession
    postings = spark.read.schema(counted.schema).parquet(f"{path}/postings")
    terms = postings.where(F.col("bucket") != WHOLE).groupBy("bucket", "term").agg(F.count("*").alias("df"))
    terms.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    texts = postings.where(F.col("bucket") == WHOLE).select(F.explode(F.array_repeat("dl", F.col("tf").cast("int"))).alias("dl"))
    whole = texts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    by_df = spark.read.schema(terms.schema).parquet(f"{path}/terms").groupBy("df").agg(F.count("*").alias("terms")).join(F.broadcast(whole.select("n")))
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = by_df.agg((F.sum(idf * F.col("terms")) / F.sum("terms")).alias("mean_idf"))
    whole.join(F.broadcast(mean)).withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")


def load(spark: SparkSession, path: str) -> Index | None:
    """The index below path; None if there is none, or a text with a token was in none of its chunks."""
    corpus = load_index(spark, f"{path}/corpus")
    row = None if corpus is None else corpus.first()
    if row is None or not row["n"]:
        return None
    return Index(spark.read.parquet(f"{path}/postings").where(F.col("bucket") != WHOLE), spark.read.parquet(f"{path}/terms"), row["n"], row["avgdl"], row["mean_idf"], row["buckets"])
