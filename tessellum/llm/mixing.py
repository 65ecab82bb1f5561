"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A document's expected copies are m = scale * weight, at most max_copies, with the scale of its source such that the
source's expected words meet its target. It is taken floor(m) times for certain; the fraction p that is left is an
inclusion probability, which differs as weights do. Within a source, documents are ranked by random odds over inclusion
odds, (u / (1 - u)) / (p / (1 - p)), and taken from the least rank on until the source's words reach its target: a
sample of fixed size, in words. u is a hash of the row and of its number among equal rows, so rows that repeat an id, or
have none, are drawn each on its own.

The cut in each source's ranking is found by passes of sums: each splits the rank's interval that holds the cut in 1024,
until about a thousand rows of the source are left in it. No task gets all rows, or all cells, of a source.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from tessellum.llm.common import HEAVY, checkpointed

#: A rank is an integer of RANK bits, and each pass of sums looks at the next BITS of them.
RANK, BITS = 60, 10


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def length_weight(size: Column) -> Column:
    """A document of fewer than 200 words weighs less than others, by its length, half at least."""
    return 0.5 + F.least(size, F.lit(200)) / 400


def targets(sizes: DataFrame, weights: Sequence[float], max_copies: float) -> DataFrame:
    """(source, size) -> (source, n, source_size, target): all sizes shared by weight, none above max_copies times its source.

    Weights go to sources by code point, null last, and repeat. Shares that stop at their cap give the rest to the
    others by weight: ordered by cap over weight, a source is capped if it is below the level left when those
    before it are. One row a source passes through a single window; the sources are the dimension, not the data.
    """
    per_source = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))))
    per_source = per_source.withColumn("w", given).withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    by_level = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(whole) - before) / left
    per_source = per_source.withColumn("level", level)
    free = F.col("cap") >= F.col("level") * F.col("w")
    per_source = per_source.withColumn("level", F.min(F.when(free, F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(whole)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return per_source.select("source", "n", "source_size", target.alias("target"))


def _of_source(rows: DataFrame, per_source: DataFrame, sources: int) -> DataFrame:
    """rows (s, ...) with their source's row; as many sources as HEAVY are broadcast."""
    return rows.join(F.broadcast(per_source) if sources <= HEAVY else per_source, F.col("s").eqNullSafe(F.col("source")))


def _with_scale(groups: DataFrame, per_source: DataFrame, max_copies: float, sources: int, most_rounds: int = 50) -> DataFrame:
    """per_source with the scale at which the words of all expected copies are the target: those whose copies are capped give their share to the others."""
    scale, was = per_source.withColumn("scale", F.lit(0.0)), None
    for _ in range(most_rounds):
        capped = F.col("scale") * F.col("weight") >= max_copies
        words = F.col("size") * F.col("repeats")
        sums = _of_source(groups.withColumnRenamed("source", "s"), scale, sources).groupBy("source").agg(
            F.sum(F.when(capped, words).otherwise(0)).alias("at_cap"), F.sum(F.when(capped, 0.0).otherwise(words * F.col("weight"))).alias("free")
        )
        joined = _of_source(sums.withColumnRenamed("source", "s"), scale.drop("scale"), sources)
        left = F.col("target") - max_copies * F.col("at_cap")
        # nothing is free at a target of all that the cap allows
        scale = joined.select("source", "n", "source_size", "target", F.when(F.col("free") > 0, left / F.col("free")).when(F.col("at_cap") > 0, 1e18).otherwise(0.0).alias("scale"), "at_cap")
        scale = checkpointed(scale)
        now = scale.agg(F.sum("at_cap")).first()[0]
        scale = scale.drop("at_cap")
        if now == was or not now:
            return scale
        was = now
    raise RuntimeError("the mix's scale did not settle")


def _copies(max_copies: float) -> tuple[Column, Column]:
    """Whole copies and the inclusion probability of one more, beside the columns of a source's row."""
    expected = F.least(F.col("scale") * F.col("weight"), F.lit(float(max_copies)))
    # a fraction that only rounding left is none
    whole = F.floor(expected + 1e-9)
    return whole, F.greatest(expected - whole, F.lit(0.0))


def _rank(p: Column, seed: int, number: Column) -> Column:
    """Pareto rank, mapped from (0, inf) to (0, 2 ** RANK)."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("k1"), F.col("k2"), number), 11) + 0.5) / F.lit(float(1 << 53))
    odds = (u / (1 - u)) * (1 - p) / p
    return F.when(p > 0, F.least((odds / (1 + odds) * float(1 << RANK)).cast("long"), F.lit((1 << RANK) - 1)))


def _key(number: Column) -> Column:
    return F.struct("rank", "k1", "k2", number.cast("long").alias("number"))


def plan(groups: DataFrame, *, weights: Sequence[float] = (5, 2, 1), max_copies: float = 3, seed: int = 17) -> tuple[DataFrame, int]:
    """One row a source (source, n, source_size, target, scale, cut), cut the last rank that is taken; and the number of sources.

    groups: (source, size, weight, k1, k2, repeats), a row for each different row k1, k2, which stands there `repeats` times.
    """
    per_source = checkpointed(targets(groups.select("source", (F.col("size") * F.col("repeats")).alias("size")), weights, max_copies))
    sources, most = per_source.agg(F.count("*"), F.max("n")).first()
    per_source = _with_scale(groups, per_source, max_copies, sources)
    whole, p = _copies(max_copies)
    rows = _of_source(groups.withColumnRenamed("source", "s"), per_source, sources)
    certain = rows.groupBy("source").agg(F.sum(whole * F.col("size") * F.col("repeats")).alias("certain"))
    rest = _of_source(certain.withColumnRenamed("source", "s"), per_source, sources).select("source", F.greatest(F.col("target") - F.col("certain"), F.lit(0.0)).alias("rest"))
    rows = rows.select("s", "size", "k1", "k2", p.alias("p"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("number"))
    rows = rows.withColumn("rank", _rank(F.col("p"), seed, F.col("number"))).where("rank is not null and size > 0")
    state = checkpointed(rest.select("source", "rest", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("before")))
    levels = min(RANK // BITS, max(1, math.ceil((math.log2(max(2, most or 0)) - BITS) / BITS)))
    of_source = Window.partitionBy("source").orderBy("cell")
    for level in range(1, levels + 1):
        inside = _of_source(rows, state, sources).where(F.shiftright("rank", RANK - BITS * (level - 1)) == F.col("at"))
        cells = inside.groupBy("source", F.shiftright("rank", RANK - BITS * level).alias("cell")).agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("rest").alias("rest"))
        cells = cells.withColumn("before", F.col("before") + F.sum("words").over(of_source) - F.col("words"))
        state = cells.where("before <= rest").groupBy("source").agg(F.max(F.struct("cell", "before", "rest")).alias("x")).select("source", "x.rest", F.col("x.cell").alias("at"), "x.before")
        state = checkpointed(state)
    shift = RANK - BITS * levels
    inside = _of_source(rows, state, sources).where(F.shiftright("rank", shift) == F.col("at"))
    in_order = Window.partitionBy("source").orderBy("rank", "k1", "k2", "number")
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(in_order) - F.col("size"))
    taken = F.max(F.when(F.col("upto") + F.col("size") / 2 <= F.col("rest"), _key(F.col("number"))))
    # if the interval's first row is already too much, all rows before it are taken and none of its own
    none = F.lit(None).cast("long")
    floor = F.struct((F.shiftleft(F.first("at"), shift) - 1).alias("rank"), F.lit((1 << 63) - 1).alias("k1"), none.alias("k2"), none.alias("number"))
    cuts = inside.groupBy("source").agg(F.coalesce(taken, floor).alias("cut")).withColumnRenamed("source", "t")
    return checkpointed(per_source.join(cuts, F.col("source").eqNullSafe(F.col("t")), "left").drop("t")), sources


def _taken(max_copies: float, seed: int, number: Column) -> Column:
    """How often the row of that number among its equals is taken, beside the columns of its source's row."""
    whole, p = _copies(max_copies)
    rank = _rank(p, seed, number)
    key = F.struct(rank.alias("rank"), F.col("k1"), F.col("k2"), number.cast("long").alias("number"))
    return (whole + F.when((p > 0) & (F.col("size") > 0) & F.coalesce(key <= F.col("cut"), F.lit(False)), 1).otherwise(0)).cast("long")


def _grouped(rows: DataFrame) -> DataFrame:
    """(doc_id, source, size, weight, k1, k2) -> a row for each different k1, k2, and its number of repeats."""
    first = [F.first(c).alias(c) for c in ("doc_id", "size", "weight")]
    return checkpointed(rows.groupBy("k1", "k2", "source").agg(*first, F.count("*").alias("repeats")))


def _hashed(value: Column, kind: DataType, seed: int) -> list[Column]:
    """What xxhash64 is to take of a value, so that nulls count by their places and maps by their entries in any order."""
    inner = lambda x, of: F.xxhash64(F.lit(seed), *_hashed(x, of, seed))
    if isinstance(kind, StructType):
        return [value.isNull(), *[x for f in kind.fields for x in _hashed(value.getField(f.name), f.dataType, seed)]]
    if isinstance(kind, ArrayType):
        return [F.size(value), F.transform(value, lambda x: inner(x, kind.elementType))]
    if isinstance(kind, MapType):
        whole = StructType().add("key", kind.keyType).add("value", kind.valueType)
        return [F.size(value), F.array_sort(F.transform(F.map_entries(value), lambda x: inner(x, whole)))]
    return [value.isNull(), value.cast("string") if isinstance(kind, VariantType) else value]


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, *, weights: Sequence[float] = (5, 2, 1), max_copies: float = 3, seed: int = 17
) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each row of docs.

    weight_col: a document's positive weight, in proportion to its expected copies; by default length_weight(). A null or
    negative weight is zero. Null text has size zero and is taken zero words; very long texts are taken whole, as others. A
    null source is a source, the last. Rows with a null id, a repeated id, or equal rows are drawn each on its own. Equal
    ranks go by hash. Reruns, and other partitions, take the same rows. An empty table gives an empty one; columns other
    than those named don't matter.
    """
    doc_id, source, text = F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col).cast("string")
    size = n_words(text)
    weight = length_weight(size) if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    key = [F.xxhash64(F.lit(k), doc_id, source, text).alias(f"k{k}") for k in (1, 2)]
    groups = _grouped(docs.select(doc_id.alias("doc_id"), source.alias("source"), size.alias("size"), weight.alias("weight"), *key))
    per_source, sources = plan(groups, weights=weights, max_copies=max_copies, seed=seed)
    rows = _of_source(groups.withColumnRenamed("source", "s"), per_source, sources).withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    return rows.select("doc_id", "size", "source_size", "target", (_taken(max_copies, seed, F.col("number")) * F.col("size")).alias("taken"))


def mixed_documents(
    docs: DataFrame, text_col: str = "text", source_col: str = "source", weight_col: str | None = None, *, weights: Sequence[float] = (5, 2, 1), max_copies: float = 3, seed: int = 17
) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it; weights, nulls, ties and empty tables as in mix().

    Equal rows are equal in all columns, nulls standing in the same places, maps by their entries in any order. Texts are not shuffled, but for tables with more than HEAVY
    different rows that stand there twice or more: only the table of sources is joined to them. Columns may have any name.
    """
    source, text = docs[f"`{source_col}`"].cast("string"), docs[f"`{text_col}`"].cast("string")
    size = n_words(text)
    weight = length_weight(size) if weight_col is None else F.greatest(F.coalesce(docs[f"`{weight_col}`"].cast("double"), F.lit(0.0)), F.lit(0.0))
    key = [F.xxhash64(F.lit(k), *[x for f in docs.schema.fields for x in _hashed(docs[f"`{f.name}`"], f.dataType, k)]).alias(f"k{k}") for k in (1, 2)]
    each = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), source.alias("s"), size.alias("size"), weight.alias("weight"), *key)
    groups = _grouped(each.select(F.lit(None).cast("long").alias("doc_id"), F.col("s").alias("source"), "size", "weight", "k1", "k2"))
    per_source, sources = plan(groups, weights=weights, max_copies=max_copies, seed=seed)
    again = checkpointed(groups.where("repeats > 1").select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), "repeats"))
    found = again.count()
    if found:
        each = each.join(F.broadcast(again) if found <= HEAVY else again, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "left").drop("r1", "r2")
        each = each.where("repeats is null").unionByName(each.where("repeats > 1").dropDuplicates(["k1", "k2"]))
    else:
        each = each.withColumn("repeats", F.lit(1).cast("long"))
    numbers = F.sequence(F.lit(1).cast("long"), F.coalesce("repeats", F.lit(1).cast("long")))
    copies = F.flatten(F.transform(numbers, lambda k: F.array_repeat(k, _taken(max_copies, seed, k).cast("int"))))
    return _of_source(each, per_source, sources).select("row", F.explode(copies)).select("row.*")
