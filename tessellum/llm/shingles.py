"""Texts as sets of word shingles, and the exact Jaccard similarity of pairs of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import with_parts

SEED = 42
#: Pairs of one text that meet it in one task, about.
PARTNERS = 256


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles' XXH64 hashes, sorted; a text with fewer words than a shingle is one, a blank text has none."""
    split = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not split:
        return np.zeros(0, np.int64)
    joined = b" ".join(split)
    ends = np.cumsum([len(w) + 1 for w in split])
    n = max(1, len(split) - words + 1)
    begins = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(begins, (ends[-n:] - 1).tolist(), strict=True)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of ids of texts (id, text): (a, b, similar), by counting their common shingles.

    An id with many pairs is dealt out in parts of PARTNERS pairs. pairs should be a checkpoint, as it is read more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            keep = []
            for a, x, b, y in zip(batch["a"].to_pylist(), batch["x"], batch["b"].to_pylist(), batch["y"], strict=True):
                for key, text in ((a, x), (b, y)):
                    if key not in known:
                        if len(known) > 64:
                            known.clear()
                        known[key] = shingles(text.as_py(), words)
                keep.append(similar(known[a] if a in known else shingles(x.as_py(), words), known[b], similarity))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(keep, pa.bool_())], ["a", "b", "similar"])

    return with_both(pairs, texts.withColumnRenamed("text", "value")).mapInArrow(run, "a long, b long, similar boolean")


def with_both(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids of values (id, value), with their values: (a, b, x, y).

    An id with many pairs is dealt out in parts, and its value is sent to each.
    """
    for end, other in (("a", "b"), ("b", "a")):
        pairs = with_parts(pairs, [end], PARTNERS).withColumn(f"{end}_part", F.pmod(F.xxhash64(other), F.col("parts"))).withColumnRenamed("parts", f"{end}_parts")

    def held(end: str, side: str) -> DataFrame:
        each = pairs.groupBy(end).agg(F.max(f"{end}_parts").alias("parts")).join(values, F.col(end) == F.col("id"))
        return each.select(end, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias(f"{end}_part"), F.col("value").alias(side))

    return pairs.join(held("a", "x"), ["a", "a_part"]).join(held("b", "y"), ["b", "b_part"]).select("a", "b", "x", "y")
