"""Near-duplicates by HyperMinHash sketches.

A sketch has REGISTERS buckets. A shingle's hash names its bucket by its last bits; of the least of a bucket's hashes the
register keeps the count of leading zeros and the MANTISSA bits after the first one, so it is a minimum written as a short
floating point number. Bands of registers are hashed, and texts that agree on a band share a bucket of texts. In each such
bucket the text that most others share buckets with is the centre, and all others are held against it: as many pairs as
members. What agreeing registers say of a pair's Jaccard similarity, less what they would agree on by chance, decides which
pairs are verified on their whole sets.

Two texts of a bucket may be similar to each other and not to the centre. So buckets that still hold texts of two
components are then compared whole, by sketches; what seems near joins clusters, and within a cluster texts are held
against each other in blocks. No pair of texts is a row there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import HEAVY, broadcastable, checkpointed
from tessellum.llm.components import connected_components
from tessellum.llm.shingles import SEED, shingles, verified, with_both
from tessellum.llm.simhash import spanning

#: Registers of a sketch, a power of two; bits of the mantissa; registers of a band. Two sets of similarity 0.85 share no
#: band with a probability of (1 - 0.85 ** 5) ** 25, 4e-7.
REGISTERS, MANTISSA, BAND = 128, 10, 5
BANDS = REGISTERS // BAND
#: A pair is verified if its estimate is at most so many standard deviations below the similarity asked for.
DEVIATIONS = 4.0
#: Members of a bucket of texts that one task gets, and texts of a side of a block that are compared whole.
SHARE, TILE, BLOCK = 4096, 1024, 512
_BITS = 64 - (REGISTERS - 1).bit_length()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """REGISTERS uint16 of a set of hashes: 0 if no hash is in the bucket, else leading zeros + 1, then the mantissa."""
    h = hashes.view(np.uint64)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    np.minimum.at(least, (h & np.uint64(REGISTERS - 1)).astype(np.int64), h >> np.uint64(64 - _BITS))
    filled = least != np.iinfo(np.uint64).max
    # the last bits are left out of the conversion, so that it doesn't round up to another power of two
    length = np.where(least < 2**53, np.frexp(least.astype(np.float64))[1], np.frexp(((least >> np.uint64(11)) << np.uint64(11)).astype(np.float64))[1])
    length = np.where(filled, np.minimum(length, _BITS), 0).astype(np.uint64)
    top = np.where(length > 0, least << (np.uint64(64) - np.maximum(length, 1).astype(np.uint64)), np.uint64(0))
    mantissa = (top >> np.uint64(63 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    register = ((np.uint64(_BITS + 1) - length) << np.uint64(MANTISSA)) | mantissa
    return np.where(filled, register, np.uint64(0)).astype(np.uint16)


def by_chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that the registers of a bucket agree for two disjoint sets of n and m hashes.

    The least hashes of the bucket are nearly exponential with rates n and m over REGISTERS; they agree if they fall in the
    same cell, and the cells of one count of leading zeros have one width.
    """
    a, b = n[..., None] / REGISTERS, m[..., None] / REGISTERS
    top = 0.5 ** np.arange(48)
    both = np.exp(-(a + b) * top / 2) - np.exp(-(a + b) * top)
    return (a * b / (a + b) * (top / 2 ** (MANTISSA + 1)) * both).sum(-1)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of sets by their sketches (last axis) and sizes, corrected for chance; and how many registers it is of."""
    used = ((x != 0) | (y != 0)).sum(-1)
    agree = ((x == y) & (x != 0)).sum(-1)
    chance = by_chance(n, m)
    return (agree / np.maximum(used, 1) - chance) / (1 - chance), used


def may_be_similar(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(whether the pair is to be verified, its estimate)."""
    guess, used = estimate(x, y, n, m)
    margin = DEVIATIONS * np.sqrt(similarity * (1 - similarity) / np.maximum(used, 1))
    return (guess >= similarity - margin) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9), guess


def with_sketches(rows: DataFrame, words: int) -> DataFrame:
    """rows (doc_id, k1, k2, text) with a set's 128-bit hash (s1, s2), its size n, its sketch and its bands in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingles(x.as_py(), words) for x in batch["text"]]
                key = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes(), SEED) for x in sets), np.int64).reshape(-1, 2)
                sketches = np.stack([sketch(x) for x in sets])
                cut = sketches[:, : BANDS * BAND].reshape(len(sets), BANDS, BAND)
                bands = [[xxhash.xxh3_64_intdigest(cut[i, b].tobytes(), b) - 2**63 for b in np.flatnonzero(cut[i].any(1)).tolist()] for i in range(len(sets))]
                arrays = [batch["doc_id"], batch["k1"], batch["k2"], pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array([len(x) for x in sets], pa.int64())]
                arrays += [pa.array([x.tobytes() for x in sketches], pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "k1", "k2", "s1", "s2", "n", "sketch", "bands"])

    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, s1 long, s2 long, n long, sketch binary, bands array<long>")


def _dealt(members: DataFrame, buckets: DataFrame, by: Column, *keys: str) -> DataFrame:
    """members with the row of their bucket (keys, size, ...); a bucket of more than SHARE members is dealt to several tasks by `by`."""
    parts = F.ceil(F.col("size") / SHARE)
    heavy = checkpointed(buckets.where(F.col("size") > SHARE).select(*keys, parts.alias("parts")))
    most = heavy.count()
    if not most:
        return members.join(buckets, [*keys])
    members = members.join(F.broadcast(heavy) if most <= HEAVY else heavy, [*keys], "left").withColumn("part", F.pmod(by, F.coalesce("parts", F.lit(1)))).drop("parts")
    return members.join(buckets.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))), [*keys, "part"]).drop("part")


def star_pairs(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), b the centre of a bucket that a is in, each once; and the members (key, id, size) of buckets of two or more.

    The centre is the member with most company in all its buckets, the least id of such: the text that others were copied
    from comes before its copies, which differ from each other more than from it.
    """
    keys = classes.select(F.explode("bands").alias("key"), "id")
    buckets = checkpointed(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    members = checkpointed(_dealt(keys, buckets, F.xxhash64("id"), "key"))
    company = members.groupBy("id").agg(F.sum("size").alias("company"))
    centres = members.join(company, "id").groupBy("key").agg(F.max(F.struct("company", (-F.col("id")).alias("id"))).alias("best"), F.first("size").alias("size"))
    centres = centres.select("key", (-F.col("best.id")).alias("b"), "size")
    pairs = _dealt(members.drop("size"), checkpointed(centres), F.xxhash64("id"), "key").select(F.col("id").alias("a"), "b").where("a <> b").distinct()
    return checkpointed(pairs), members


def estimated(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b): (a, b, guess) of those that may be similar, by the sketches of classes (id, n, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                x, y = (np.frombuffer(b"".join(batch[side].field("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS) for side in ("x", "y"))
                n, m = (batch[side].field("n").to_numpy(zero_copy_only=False) for side in ("x", "y"))
                may, guess = may_be_similar(x, y, n, m, similarity)
                keep = pa.array(may)
                yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep), pa.array(guess[may])], ["a", "b", "guess"])

    return with_both(pairs, classes.select("id", F.struct("n", "sketch").alias("value"))).mapInArrow(run, "a long, b long, guess double")


def _near_components(tile: pa.Table, similarity: float) -> pa.Table:
    """(a, b): links between components that join what holds a near pair of the tile's two parts."""
    column = lambda name: tile[name].combine_chunks().to_numpy(zero_copy_only=False)
    sketches = np.frombuffer(b"".join(tile["sketch"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
    n, names, second = column("n"), column("component"), column("part") != column("left")
    _, label = np.unique(names, return_inverse=True)
    label = np.unique(label, return_index=True)[1][label]
    alone = column("left")[0] == column("right")[0]
    left = np.arange(len(n)) if alone else np.flatnonzero(~second)
    right = left if alone else np.flatnonzero(second)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, (1 << 22) // (REGISTERS * max(1, len(right))))
    for at in range(0, len(left), step):
        i, j = np.repeat(left[at : at + step], len(right)), np.tile(right, len(left[at : at + step]))
        apart = (label[i] != label[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
        i, j = i[apart], j[apart]
        may, guess = may_be_similar(sketches[i], sketches[j], n[i], n[j], similarity)
        found.extend((names[x], names[y]) for x, y in spanning(label, i[may], j[may], -guess[may]))
    return pa.table({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})


def near_components(members: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components of known (id, n, sketch, component), by the buckets (key, id, size) that still hold two of them.

    A bucket of two was its centre's pair, and is not looked at again.
    """
    # one component's members say nothing of each other
    mixed = members.where("size > 2").join(known.select("id", "component"), "id")
    several = mixed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size")).where("least < most").select("key", "size")
    several = checkpointed(several)
    parts = F.ceil(F.col("size") / TILE)
    points = _dealt(mixed.select("key", "id"), several, F.xxhash64("id"), "key").withColumn("parts", parts)
    points = points.withColumn("part", F.pmod(F.xxhash64("id", F.lit("tile")), F.col("parts"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    points = points.select("key", F.least("part", "with").alias("left"), F.greatest("part", "with").alias("right"), "part", "id")
    points = points.join(known.select("id", "n", "sketch", "component"), "id")
    return points.groupBy("key", "left", "right").applyInArrow(lambda tile: _near_components(tile, similarity), "a long, b long").distinct()


def _compared(block: pa.Table, words: int, similarity: float) -> pa.Table:
    """(a, b): similar texts of the block that join its components as all similar pairs would, of which one asks."""
    ids, asks, names = (block[c].to_numpy() for c in ("id", "asks", "component"))
    sets = [shingles(x.as_py(), words) for x in block["text"]]
    size = np.array([len(x) for x in sets])
    to = np.flatnonzero(~asks)
    out: list[tuple[int, int]] = []
    upper = {name: name for name in names.tolist()}

    def root(name: int) -> int:
        while upper[name] != name:
            upper[name] = name = upper[upper[name]]
        return name

    if len(to):
        held, owner = np.concatenate([sets[k] for k in to]), np.repeat(np.arange(len(to)), size[to])
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        for k in np.flatnonzero(asks):
            lo, hi = np.searchsorted(held, sets[k], "left"), np.searchsorted(held, sets[k], "right")
            n = hi - lo
            both = np.bincount(owner[np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)], minlength=len(to))
            good = to[np.flatnonzero((both >= similarity * (size[k] + size[to] - both) - 1e-9) & (names[to] != names[k]))]
            for x in good[np.unique(names[good], return_index=True)[1]]:
                if root(int(names[x])) != root(int(names[k])):
                    upper[root(int(names[x]))] = root(int(names[k]))
                    out.append((ids[k], ids[x]))
    return pa.table({"a": np.array([x for x, _ in out], np.int64), "b": np.array([y for _, y in out], np.int64)})


def within_clusters(known: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) of similar texts of different components of a cluster; known: (id, cluster, component), texts: (id, text).

    All but the members of the largest component ask, all answer, in blocks of BLOCK by BLOCK texts.
    """
    sizes = known.groupBy("cluster", "component").agg(F.count("*").alias("size"))
    shape = checkpointed(sizes.groupBy("cluster").agg(F.max(F.struct("size", "component"))["component"].alias("largest"), F.sum("size").alias("all"), F.max("size").alias("most")))
    shape = shape.select("cluster", "largest", F.ceil(F.col("all") / BLOCK).alias("parts"), F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("turns"))
    few = shape.count() <= HEAVY
    rows = known.join(F.broadcast(shape) if few else shape, "cluster")
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one_of = lambda n: F.pmod(F.xxhash64("id", F.lit("block")), F.col(n))
    columns = ["cluster", "turn", "part", "id", "component", "asks"]
    left = rows.where("component <> largest").withColumn("turn", one_of("turns")).withColumn("part", all_of("parts")).withColumn("asks", F.lit(True))
    right = rows.withColumn("part", one_of("parts")).withColumn("turn", all_of("turns")).withColumn("asks", F.lit(False))
    blocks = left.select(*columns).unionByName(right.select(*columns)).join(texts, "id")
    return blocks.groupBy("cluster", "turn", "part").applyInArrow(lambda block: _compared(block, words, similarity), "a long, b long")


def _components(classes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """classes with the component that links give their id; its own id without a link."""
    found = connected_components(links).select(F.col("id").alias("linked"), F.col("component").alias("found"))
    return classes.join(found, F.col("id") == F.col("linked"), "left").withColumn(name, F.coalesce("found", "id")).drop("linked", "found")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, similarity: float = 0.85) -> DataFrame:
    """(doc_id long, n_shingles long, component_id long, kept boolean), a row for each row of docs.

    Texts whose sets of `words`-word shingles have a Jaccard similarity of `similarity` or more are linked, and every link is
    counted on the whole sets. A link is missed if two sketches share no band, or disagree by more than DEVIATIONS: about one in
    ten thousand of those just at the similarity, fewer beyond. component_id is the least doc_id of what links join; kept says
    that the row has it. A text with fewer words than a shingle is one shingle; null and blank texts have none and are linked with
    nothing, so they are their own component. Very long texts are taken whole. Equal sets are one class, so repeated rows and
    copies are linked whatever their number, each with a row of its own. Rows with a null id link others; their component_id
    is null only if all of the component are, and they are not kept. An empty table gives an empty one; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", *[F.xxhash64(F.lit(k), F.col("doc_id").isNull(), "doc_id", "text").alias(f"k{k}") for k in (1, 2)], "text")
    each = checkpointed(with_sketches(rows, words))
    first = F.min(F.struct("k1", "k2")).alias("first")
    classes = each.where("n > 0").groupBy("s1", "s2").agg(F.count("*").alias("size"), F.min("doc_id").alias("least"), first, F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    # numbers of the checkpoint's rows, which are the same in each reading
    classes = checkpointed(classes).withColumn("id", F.monotonically_increasing_id())

    def texts(ids: DataFrame) -> DataFrame:
        needed = checkpointed(classes.select("id", F.col("first.k1").alias("n1"), F.col("first.k2").alias("n2")).join(ids, "id", "left_semi"))
        few = broadcastable(needed.select(F.col("n1").alias("k1")))
        asked = rows if few is None else rows.join(few, "k1", "left_semi")
        return checkpointed(asked.join(needed, (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2"))).select("id", "text").dropDuplicates(["id"]))

    pairs, members = star_pairs(classes)
    pairs = checkpointed(estimated(pairs, classes, similarity))
    held = texts(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    # the likeliest pair of each text first; of the others only those that it leaves between two components
    best = checkpointed(pairs.groupBy("a").agg(F.max(F.struct("guess", "b"))["b"].alias("b")))
    links = checkpointed(verified(best, held, words, similarity).where("similar").select("a", "b"))
    known = checkpointed(_components(classes.select("id"), links, "component"))
    of = lambda end: known.select(F.col("id").alias(end), F.col("component").alias(f"{end}_component"))
    rest = pairs.join(best, ["a", "b"], "left_anti").join(of("a"), "a").join(of("b"), "b").where("a_component <> b_component").select("a", "b")
    links = checkpointed(links.unionByName(verified(checkpointed(rest), held, words, similarity).where("similar").select("a", "b")))
    known = checkpointed(_components(classes.select("id", "n", "sketch"), links, "component"))

    near = checkpointed(near_components(members, known, similarity))
    if near.head(1):
        clusters = connected_components(near).select(F.col("id").alias("component"), F.col("component").alias("cluster"))
        asked = checkpointed(known.select("id", "component").join(clusters, "component"))
        links = checkpointed(links.unionByName(within_clusters(asked, texts(asked.select("id")), words, similarity)))
    joined = checkpointed(_components(classes.select("id", "s1", "s2", "least", "size"), links, "component"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id")).repartition("component")
    named = checkpointed(joined.join(least, "component").select("s1", "s2", "size", "component_id"))
    full = each.where("n > 0").select("doc_id", "n", "s1", "s2", F.monotonically_increasing_id().alias("row"))
    full = _dealt(full, named, F.col("row"), "s1", "s2").select("doc_id", "n", "component_id")
    out = full.unionByName(each.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
