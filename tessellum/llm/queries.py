"""The query op<N>_<name> of each training-data operator, and SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm import credentials, dialogue, hyperminhash, langid, licenses, lm, media, mixing, pieces, quality, quantize, simhash, urls
from tessellum.llm.common import crc_mod, documents


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters trained on documents whose crc32 is not 1 modulo 3, applied to all."""
    docs = documents(spark, sf_dir)
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = langid.train(docs.where(~held_out).select("text", "lang"))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, keep={"held_out": F.col("held_out")})


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rules; for the other URLs the model of the labelled table."""
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by code point weigh 5, 2, 1, repeating; at most three copies."""
    return mixing.mix(documents(spark, sf_dir), weights=(5, 2, 1), max_copies=3)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text; text_sha256 is of the text decoded from them."""
    encoded = pieces.encode(documents(spark, sf_dir))
    decoded = pieces.decode(encoded.select("doc_id", "ids", "n_tokens", "exact"))
    return decoded.select("doc_id", "ids", "n_tokens", "exact", F.sha2("text", 256).alias("text_sha256"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has sound, so each document's bytes are taken as a recording of 8-bit samples; ids divisible by 20 are the queries."""
    return media.search(documents(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("media")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, 64 bits, links at four or fewer differing bits."""
    found = simhash.near_duplicates(documents(spark, sf_dir), words=4, width=1, budget=4, per_word=5)
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a repository, its source the owner."""
    return credentials.digest(credentials.scan(documents(spark, sf_dir)))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's features and base rule, then the cascade of the method's rules."""
    return quality.judged(documents(spark, sf_dir))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, and blocks that contain 0.85 of a template's words."""
    return licenses.scan(documents(spark, sf_dir))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32 is not 1 modulo 5, scores all."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 5) == 1
    model, counts = lm.train(docs.where(~held_out).select("text"))
    return lm.score(docs, model, counts, keep={"held_out": held_out})


def op11_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table with faults planted by a hash of conversation and turn, then repaired."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return dialogue.repairs(dialogue.damage(rows))


def op12_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of five-word shingles, links at a Jaccard similarity of 0.85."""
    return hyperminhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight parts, 16 entries, six rounds."""
    return quantize.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_urls": op2_urls,
    "op3_mixing": op3_mixing,
    "op4_pieces": op4_pieces,
    "op5_media": op5_media,
    "op6_simhash": op6_simhash,
    "op7_secrets": op7_secrets,
    "op8_quality": op8_quality,
    "op9_licenses": op9_licenses,
    "op10_lm": op10_lm,
    "op11_dialogue": op11_dialogue,
    "op12_hyperminhash": op12_hyperminhash,
    "op13_codes": op13_codes,
}
ORACLE_SQL: dict[str, str] = {"op8_quality": quality.ORACLE, "op9_licenses": licenses.ORACLE}
