"""SimHash near-duplicates by a binary trie self-join.

A fingerprint is `width` 64-bit numbers, the majority bits of the XXH64 hashes of a text's word shingles.
Equal fingerprints are one class. Classes are linked by tries, each rooted at another slice of the
fingerprint's bits: below a root, pairs of trie nodes are walked together, differing bits add up, and a pair
of nodes is dropped as soon as they exceed the budget. With more disjoint slices that cover all bits than the
budget has errors, any pair within the budget agrees on a whole slice, so the walk loses no link.

near_duplicates() takes the fingerprints' distance as the answer. without_near_duplicates() takes it as the search for
candidates, and decides by the exact Jaccard similarity of the two texts' sets of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import broadcastable, checkpointed, fresh, with_parts
from tessellum.llm.components import connected_components
from tessellum.llm.shingles import SEED, shingles, verified

#: Points of one trie that a task walks at once; a fuller trie is walked as pairs of parts this large.
TILE = 4096
#: Points that a task gets in one group, about.
SHARD = 30_000
#: Pairs of points compared in one go.
PAIRS = 1 << 21
#: Texts of one side of a block of between_components().
BLOCK = 512
#: Of the fingerprints of without_near_duplicates(): words compared; standard deviations of the distance at the
#: similarity asked for, above its mean, that the budget has; least bits of a slice; and a slice value has about
#: 2 ** CROWD classes by chance, so that slices get wider as classes get more.
COMPARED, DEVIATIONS, LEAST_SLICE, CROWD = 4, 3.5, 13, 8
#: Slices in which its forest is looked for.
FIRST = 12
_LANES = np.uint64(0x0101010101010101)
_WEYL = 0x9E3779B97F4A7C15


def _counts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of h that starts at starts: how many of its numbers have each of the 64 bits."""
    ends = np.append(starts[1:], len(h))
    parts = -(-(ends - starts) // 255)
    first = np.cumsum(parts) - parts
    cut = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    out = np.empty((len(starts), 64), np.int64)
    for k in range(8):  # eight counters of 8 bits a number; a part of 255 numbers can't overflow them
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, cut).view(np.uint8).reshape(-1, 8)
        out[:, k::8] = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
    return out


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits from h; word 0 is h itself."""
    if not word:
        return h
    z = h + np.uint64(word * _WEYL % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Of each run of hashes that starts at starts, `width` numbers of the bits that more than half of its hashes have."""
    n = np.diff(np.append(starts, len(hashes)))
    out = np.empty((len(starts), width), np.uint64)
    for w in range(width):
        bits = 2 * _counts(_mixed(hashes, w), starts) > n[:, None]
        out[:, w] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(texts: Sequence[str | None], words: int, width: int) -> np.ndarray:
    """One row of `width` unsigned 64-bit numbers for each text, of its shingles with their repeats."""
    out = np.zeros((len(texts), width), np.uint64)
    rows: list[int] = []
    hashes: list[int] = []
    starts: list[int] = []

    def flush() -> None:
        if rows:
            out[rows] = majority(np.array(hashes, np.uint64), np.array(starts, np.int64), width)
        rows.clear(), hashes.clear(), starts.clear()

    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        split = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
        if not split:
            continue
        joined = b" ".join(split)
        rows.append(i)
        starts.append(len(hashes))
        if len(split) <= words:
            hashes.append(digest(joined, SEED))
        else:
            ends = np.cumsum([len(w) + 1 for w in split])
            at = [0, *(ends[: len(split) - words]).tolist()]
            hashes.extend([digest(joined[a:b], SEED) for a, b in zip(at, (ends[words - 1 :] - 1).tolist(), strict=True)])
        if len(hashes) > 500_000:
            flush()
    flush()
    return out


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, width: int) -> DataFrame:
    """(doc_id long, fp array of `width` longs), a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                fp = fingerprints(batch["text"].to_pylist(), words, width).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], _lists(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp array<long>")


def _lists(fp: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1) * fp.shape[1], pa.int32()), pa.array(fp.ravel()))


def with_sets(rows: DataFrame, words: int, width: int) -> DataFrame:
    """rows, whose last column is text, with a set's 128-bit hash (s1, s2), its size n and fingerprint fp in place of the text."""
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingles(x.as_py(), words) for x in batch.columns[-1]]
                key = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes(), SEED) for x in sets), np.int64).reshape(-1, 2)
                n = np.array([len(x) for x in sets], np.int64)
                fp = np.zeros((len(sets), width), np.uint64)
                if n.any():
                    fp[n > 0] = majority(np.concatenate(sets).view(np.uint64), (np.cumsum(n) - n)[n > 0], width)
                arrays = [*batch.columns[:-1], pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(n.astype(np.int32)), _lists(fp.view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, [*names, "s1", "s2", "n", "fp"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, s1 long, s2 long, n int, fp array<long>")


def slices(width: int, count: int) -> list[tuple[int, int, int]]:
    """(word, shift, bits) of `count` disjoint slices a 64-bit word, that cover all bits."""
    cuts = [round(k * 64 / count) for k in range(count + 1)]
    return [(w, a, b - a) for w in range(width) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass(frozen=True)
class Search:
    """How candidates of a similarity are looked for: words of a fingerprint, its slices, and the budget of differing bits."""

    width: int
    cut: list[tuple[int, int, int]]
    budget: int

    @classmethod
    def of(cls, similarity: float, recall: float, total: int) -> Search:
        """For `total` texts. Two sets of one size and that similarity have a bit apart with probability arccos(share) / pi."""
        differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
        bits = min(32, max(LEAST_SLICE, math.ceil(math.log2(max(2, total))) - CROWD))
        count = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** bits)) if differ else 1
        each = 64 // bits
        cut = [(k // each, k % each * bits, bits) for k in range(count)]
        bound = 64 * COMPARED
        budget = math.ceil(bound * differ + DEVIATIONS * math.sqrt(bound * differ * (1 - differ)))
        return cls(max(COMPARED, cut[-1][0] + 1), cut, budget)


def walk(fp: np.ndarray, a: np.ndarray, b: np.ndarray, budget: int, label: np.ndarray, visit: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> None:
    """Walks pairs of tries over the rows of fp and calls visit(i, j, differing bits) for rows within `budget` differing bits.

    a, b: (k, 2) row ranges, sorted each by its bits from the first word's highest on; a pair of equal ranges
    is a trie against itself. Rows of one label are not compared; visit may join labels.
    """
    n, width = fp.shape
    ones: dict[int, np.ndarray] = {}

    def split(node: np.ndarray, depth: int) -> np.ndarray:
        if depth not in ones:
            bit = (fp[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32)
        c = ones[depth]
        return node[:, 1] - (c[node[:, 1]] - c[node[:, 0]])

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        differ = np.zeros(len(i), np.int32)
        for w in range(width):
            differ += np.bitwise_count(fp[i, w] ^ fp[j, w])
        near = differ <= budget
        if near.any():
            visit(i[near], j[near], differ[near])

    todo = [(0, a.astype(np.int64), b.astype(np.int64), np.zeros(len(a), np.int32))]
    while todo:
        depth, a, b, acc = todo.pop()
        if not len(a):
            continue
        na, nb = a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]
        same = a[:, 0] == b[:, 0]
        small = (na * nb <= 256) | (depth >= 64 * width)
        small &= ~(same & (na < 2))
        for pick in np.array_split(np.flatnonzero(small), max(1, int((na * nb)[small].sum() // PAIRS))):
            if len(pick):
                size = (na * nb)[pick]
                row = np.repeat(np.arange(len(pick)), size)
                k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                i, j = a[pick, 0][row] + k // nb[pick][row], b[pick, 0][row] + k % nb[pick][row]
                keep = ~(same[pick][row]) | (i < j)
                compare(i[keep], j[keep])
        large = ~small & ~(same & (na < 2))
        if not large.any():
            continue
        a, b, acc, same = a[large], b[large], acc[large], same[large]
        ma, mb = split(a, depth), split(b, depth)
        lo = lambda x, m: np.column_stack([x[:, 0], m])
        hi = lambda x, m: np.column_stack([m, x[:, 1]])
        other = ~same
        na = np.concatenate([lo(a, ma), hi(a, ma), lo(a, ma), hi(a[other], ma[other])])
        nb = np.concatenate([lo(b, mb), hi(b, mb), hi(b, mb), lo(b[other], mb[other])])
        nacc = np.concatenate([acc, acc, acc + 1, acc[other] + 1])
        keep = (nacc <= budget) & (na[:, 1] > na[:, 0]) & (nb[:, 1] > nb[:, 0])
        na, nb, nacc = na[keep], nb[keep], nacc[keep]
        for at in range(0, len(na), 200_000):
            todo.append((depth + 1, na[at : at + 200_000], nb[at : at + 200_000], nacc[at : at + 200_000]))


def union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins i[k] and j[k] for all k: label[x] is the least row of x's set, before and after."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def spanning(label: np.ndarray, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join in label what the pairs (i, j) join, in rounds: each set takes its nearest pair to another."""
    order = np.argsort(far, kind="stable")
    i, j = i[order], j[order]
    while True:
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        picked = np.unique(np.concatenate([np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1]]))
        yield i[picked], j[picked]
        union(label, i[picked], j[picked])


def _linked(group: pa.Table, budget: int, what: str, similarity: float) -> pa.Table:
    """(a, b) of a shard's tries. what:

    - "classes": as few links as join what is near, each row to the least of its set;
    - "forest": spanning links over nearest pairs;
    - "rows": each row that is near another, of another component if rows have one, as both a and b;
    - "components": the pairs of components that hold a near pair.

    With a similarity above 0, rows whose sizes n, or numbers of shingles that others may share, rule it out are no pair.
    """
    column = lambda name: group[name].combine_chunks().to_numpy(zero_copy_only=False)
    ids = column("id")
    fp = group["fp"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), -1)
    trie = np.column_stack([column(c).astype(np.int64) for c in ("table", "key", "left", "right")])
    second = (column("part") != column("left")).astype(np.int64)
    order = np.lexsort((*[fp[:, w] for w in range(fp.shape[1] - 1, -1, -1)], second, trie[:, 3], trie[:, 2], trie[:, 1], trie[:, 0]))
    fp, trie, second, ids = fp[order], trie[order], second[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (trie[1:] != trie[:-1]).any(1)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(ids))
    mid = lo + np.add.reduceat(1 - second, lo)
    alone = trie[lo, 2] == trie[lo, 3]
    a = np.column_stack([lo, mid])
    b = np.where(alone[:, None], a, np.column_stack([mid, hi]))
    keep = (b[:, 1] > b[:, 0]) & (a[:, 1] > a[:, 0])
    # a class stands in many tries of the shard: all its places are one label from the start
    parted = "component" in group.column_names
    names = column("component")[order] if parted else ids
    _, first, same = np.unique(names, return_index=True, return_inverse=True)
    least = np.full(len(first), len(ids))
    np.minimum.at(least, same, np.arange(len(ids)))
    label = least[same]
    size, shared = column("n")[order].astype(np.int64), column("shared")[order].astype(np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    near = np.zeros(len(ids), bool)

    # rows with many shingles of their own are far from all: nearest is who has few, too
    own = 64 * fp.shape[1] * (1 - shared / np.maximum(1, size))

    def visit(i: np.ndarray, j: np.ndarray, far: np.ndarray) -> None:
        may = np.minimum(shared[i], shared[j]) >= similarity / (1 + similarity) * (size[i] + size[j]) - 1e-9
        i, j, far = i[may], j[may], far[may]
        near[i] = near[j] = True
        if what == "components":
            ends = np.unique(np.column_stack([np.minimum(names[i], names[j]), np.maximum(names[i], names[j])]), axis=0)
            found.append((ends[:, 0], ends[:, 1]))
        elif what == "forest":
            found.extend((np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])) for x, y in spanning(label, i, j, far + own[i] + own[j]))
        elif not parted:
            union(label, i, j)

    walk(fp, a[keep], b[keep], budget, label, visit)
    if what == "classes":
        apart = ids != ids[label]
        found.append((ids[apart], ids[label][apart]))
    elif what == "rows":
        found.append((ids[near], ids[near]))
    return pa.table({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])}).group_by(["a", "b"]).aggregate([])


def trie_links(classes: DataFrame, cut: Sequence[tuple[int, int, int]], compare: int, budget: int, total: int, what: str = "classes", similarity: float = 0.0) -> DataFrame:
    """Pairs (a, b), as _linked() says, of classes (id, fp) whose fingerprints differ in at most `budget` of the first `compare` words' bits and agree on a slice of cut.

    Classes may have a set's size n, how many of its shingles others may share, and a component, whose own pairs are left
    out. total: the number of classes, for the number of groups. A slice value that many classes share is dealt
    out as pairs of parts of TILE classes.
    """
    keep = [F.col(c).cast("int") if c in classes.columns else F.lit(0).alias(c) for c in ("n", "shared")] + [F.col(c) for c in classes.columns if c == "component"]
    keys = F.array(*[F.shiftrightunsigned(F.col("fp")[w], shift).bitwiseAND(F.lit((1 << bits) - 1)) for w, shift, bits in cut])
    points = classes.select("id", *keep, F.slice("fp", 1, compare).alias("fp"), F.posexplode(keys).alias("table", "key"))
    kept = [c for c in ("n", "shared", "component") if c in points.columns]
    points = with_parts(points, ["table", "key"], TILE)
    points = points.withColumn("part", F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")))
    points = points.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    points = points.withColumn("left", F.least("part", "with")).withColumn("right", F.greatest("part", "with"))
    shards = max(1, math.ceil(total * len(cut) / SHARD))
    points = points.withColumn("shard", F.pmod(F.xxhash64("table", "key", "left", "right"), F.lit(shards)).cast("int"))
    points = points.select("shard", F.col("table").cast("short"), F.col("key").cast("int"), F.col("left").cast("int"), F.col("right").cast("int"), F.col("part").cast("int"), "id", *kept, "fp")
    return points.groupBy("shard").applyInArrow(lambda group: _linked(group, budget, what, similarity), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 4, width: int = 1, compare: int | None = None, budget: int = 4, per_word: int = 5
) -> DataFrame:
    """(doc_id long, fp array of longs, component_id long), a row for each row of docs.

    words: shingle length; width: 64-bit words of the fingerprint; compare: how many of them are compared, all if
    None; budget: differing bits of a link; per_word: tries rooted in each 64-bit word. If all are compared and
    per_word * width > budget, the join is exact; else tries that two close fingerprints don't share may miss them.
    A null or blank text has fingerprint zero and is linked like any other; a text with fewer words than a
    shingle is one shingle; very long texts are taken whole. Repeated rows each get their row. component_id is the least
    id of all rows whose fingerprints are linked, directly or by others; rows with a null id link others, too, and if all
    of a component's ids are null, so is it. Rows are linked by fingerprint alone, so rows with one id and far
    fingerprints are not. An empty table gives an empty one. Columns other than the two named are not read.
    """
    each = checkpointed(with_fingerprints(docs, id_col, text_col, words, width))
    named = checkpointed(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # numbers of the checkpoint's rows, which are the same in each reading
    classes = named.withColumn("id", F.monotonically_increasing_id())
    links = trie_links(classes.select("id", "fp"), slices(width, per_word), compare or width, budget, named.count())
    found = connected_components(links).withColumnRenamed("id", "linked")
    joined = classes.join(found, F.col("id") == F.col("linked"), "left").select("fp", "least", F.coalesce("component", "id").alias("component"))
    joined = checkpointed(joined)
    least = joined.groupBy("component").agg(F.min("least").alias("component_id")).repartition("component")
    named = joined.join(least, "component").select(F.col("fp").alias("class_fp"), "component_id")
    return each.join(named, each["fp"] == named["class_fp"]).select("doc_id", "fp", "component_id")


def with_shared(classes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """classes (id, n, ...) with shared: how many of a class's shingles another of texts (id, text) has, too.

    A shingle that no other text has is in no overlap, so a class with too few shared ones is like no other and is left out.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                held = shingles(text.as_py(), words)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), key)), pa.array(held)], ["id", "token"])

    alone = texts.mapInArrow(tokens, "id long, token long").groupBy("token").agg(F.count("*").alias("texts"), F.min("id").alias("holder")).where("texts = 1")
    alone = alone.groupBy("holder").agg(F.count("*").alias("alone"))
    known = classes.join(alone, F.col("id") == F.col("holder"), "left").withColumn("shared", (F.col("n") - F.coalesce("alone", F.lit(0))).cast("int")).drop("alone", "holder")
    return known.where(F.col("shared") >= similarity * F.col("n") - 1e-9)


def between_components(known: DataFrame, texts: DataFrame, near: Callable[[DataFrame], DataFrame], words: int, similarity: float) -> DataFrame:
    """Links (a, b) that join the components of known (id, n, shared, fp, component) that hold a similar pair which is near, too; texts: (id, text).

    near gives the pairs of components that hold a near pair. Of such a pair, the smaller component's members ask the
    larger's, in blocks of BLOCK by BLOCK texts; no pair of texts is a row, and of an asker's answers one is enough.
    """
    texts = checkpointed(texts.join(known.select("id"), "id", "left_semi"))
    pairs = checkpointed(near(known))
    members = known.select("component", "id")
    size = checkpointed(members.groupBy("component").agg(F.count("*").alias("size")))
    of = lambda end: size.select(F.col("component").alias(end), F.col("size").alias(f"{end}_size"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b")
    small = F.col("a_size") <= F.col("b_size")
    sized = sized.select(F.when(small, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(small, F.col("b")).otherwise(F.col("a")).alias("y"), F.greatest("a_size", "b_size").alias("size"))
    asks = checkpointed(sized.join(members.select(F.col("component").alias("x"), "id"), "x").select("y", "size", "id"))
    shape = asks.groupBy("y").agg(F.ceil(F.first("size") / BLOCK).alias("parts"), F.ceil(F.count("*") / BLOCK).alias("turns"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one_of = lambda n: F.pmod(F.xxhash64("id", F.lit("block")), F.col(n))
    left = asks.select("y", "id").join(shape, "y").select("y", one_of("turns").alias("turn"), all_of("parts").alias("part"), "id", F.lit(True).alias("asks"))
    right = members.withColumnRenamed("component", "y").join(shape, "y").select("y", all_of("turns").alias("turn"), one_of("parts").alias("part"), "id", F.lit(False).alias("asks"))

    def answered(block: pa.Table) -> pa.Table:
        ids, asking = block["id"].to_numpy(), block["asks"].to_numpy()
        sets = [shingles(x.as_py(), words) for x in block["text"]]
        size = np.array([len(x) for x in sets])
        to = np.flatnonzero(~asking)
        out = []
        if len(to):
            held, owner = np.concatenate([sets[k] for k in to]), np.repeat(np.arange(len(to)), size[to])
            order = np.argsort(held, kind="stable")
            held, owner = held[order], owner[order]
            for k in np.flatnonzero(asking):
                lo, hi = np.searchsorted(held, sets[k], "left"), np.searchsorted(held, sets[k], "right")
                n = hi - lo
                both = np.bincount(owner[np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)], minlength=len(to))
                good = np.flatnonzero(both >= similarity * (size[k] + size[to] - both) - 1e-9)
                if len(good):
                    out.append((ids[k], ids[to[good[0]]]))
        return pa.table({"a": np.array([x for x, _ in out], np.int64), "b": np.array([y for _, y in out], np.int64)})

    return left.unionByName(right).join(texts, "id").groupBy("y", "turn", "part").applyInArrow(answered, "a long, b long")


def similar_links(classes: DataFrame, texts: Callable[[DataFrame], DataFrame], search: Search, words: int, similarity: float, total: int) -> DataFrame:
    """Links (a, b) between classes (id, n, fp) of that Jaccard similarity that join what all such pairs of the search's candidates join.

    texts: of a table of ids, (id, text); it is asked once, for the classes that are near another, and those go whose own
    shingles are too many. First a spanning forest
    of nearest pairs in the first FIRST slices is verified, so that a large group of near copies is mostly one component by
    about as many links as it has members; then one in all slices, over the classes that are still near one of another
    component. The components that are near after that are compared whole.
    """

    def near(some: DataFrame, n: int, what: str, cut: Sequence[tuple[int, int, int]] = search.cut) -> DataFrame:
        return trie_links(some, cut, COMPARED, search.budget, n, what, similarity)

    classes = classes.withColumn("shared", F.col("n"))
    ids = checkpointed(near(classes, total, "rows").select("a"))
    classes = checkpointed(classes.join(ids.withColumnRenamed("a", "id"), "id", "left_semi"))
    held = checkpointed(texts(classes.select("id")))
    classes = checkpointed(with_shared(classes.drop("shared"), held, words, similarity))
    first = classes.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).limit(0)
    known = classes.withColumn("component", F.col("id"))
    for cut in (search.cut[:FIRST], search.cut):
        pairs = checkpointed(near(known, known.count(), "forest", cut))
        first = checkpointed(first.unionByName(verified(pairs, held, words, similarity).where("similar").select("a", "b")))
        joined = connected_components(first).withColumnRenamed("id", "linked")
        known = known.drop("component").join(joined, F.col("id") == F.col("linked"), "left").withColumn("component", F.coalesce("component", "id")).drop("linked")
        known = checkpointed(known)
        apart = near(known, known.count(), "rows").select(F.col("a").alias("id"))
        known = checkpointed(known.join(apart, "id", "left_semi"))
    between = between_components(known, held, lambda x: near(x, x.count(), "components"), words, similarity)
    return first.unionByName(checkpointed(between))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, similarity: float = 0.8, recall: float = 0.995) -> DataFrame:
    """The rows of docs, all columns, that stand for their group of near-duplicates: of each group the least id, null last, ties by hash.

    Texts whose sets of `words`-word shingles have a Jaccard similarity of `similarity` or more are one group, and so is
    what such pairs join. Candidates are near fingerprints of the sets, and each is verified exactly, so that no text goes
    without a chain of such pairs to one that stays. recall: the probability that a pair just at that similarity is a
    candidate, by its slices; the more alike two texts are, the higher it is, and equal sets always are one. Null and blank
    texts are one group, repeated rows are one row, very long texts are taken whole, an empty table gives an empty one.
    Rows are told apart by 128 bits of id and text, so an id may stand on several texts; other columns may have any name.
    Texts are shuffled only if they are compared or go, as long as the keys of these are few enough to be broadcast
    (FEW_KEYS); beyond that, all are.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k1, k2 = fresh(docs, "row_1", "row_2")
    marked = docs.withColumn(k1, F.xxhash64(F.lit(1), F.col(id_col), text)).withColumn(k2, F.xxhash64(F.lit(2), F.col(id_col), text))
    key = [F.col(k1).alias("k1"), F.col(k2).alias("k2")]
    search = Search.of(similarity, recall, docs.count())
    rows = marked.select(F.col(id_col).alias("doc_id"), *key, text.alias("text"))
    rows = checkpointed(with_sets(rows, words, search.width))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("least")
    classes = checkpointed(rows.groupBy("s1", "s2").agg(least, F.first("n").alias("n"), F.first("fp").alias("fp")).drop("s1", "s2"))
    classes = classes.withColumn("id", F.monotonically_increasing_id())  # of a checkpoint, so the same in each reading

    def texts(ids: DataFrame) -> DataFrame:
        needed = checkpointed(classes.select("id", "least.k1", "least.k2").join(ids, "id", "left_semi").withColumnsRenamed({"k1": "n1", "k2": "n2"}))
        asked = marked.select(*key, text.alias("text"))
        few = broadcastable(needed.select(F.col("n1").alias("k1")))
        if few is not None:  # only texts that may be asked for are shuffled
            asked = asked.join(few, "k1", "left_semi")
        return asked.join(needed, (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2"))).select("id", "text").dropDuplicates(["id"])

    some = classes.where("n > 0").select("id", "n", "fp")
    found = connected_components(similar_links(some, texts, search, words, similarity, classes.count())).withColumnRenamed("id", "linked")
    stays = classes.join(found, F.col("id") == F.col("linked"), "left").groupBy(F.coalesce("component", "id").alias("component")).agg(F.min("least").alias("least"))
    stays = checkpointed(stays.select(F.col("least.k1").alias(k1), F.col("least.k2").alias(k2)))
    # rows that go or that are repeated; all others stay as they are, without a shuffle of their texts if these are few
    times = rows.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.count("*").alias("times"))
    in_doubt = times.join(stays.withColumn("stays", F.lit(True)), [k1, k2], "left").where("times > 1 or stays is null").select(k1)
    few = broadcastable(checkpointed(in_doubt))
    judged = marked if few is None else marked.join(few, k1, "left_semi")
    kept = judged.join(stays, [k1, k2], "left_semi").dropDuplicates([k1, k2])
    if few is not None:
        kept = marked.join(few, k1, "left_anti").unionByName(kept)
    return kept.select(*[f"`{c}`" for c in docs.columns])


def fingerprint_hex(fp: Column) -> Column:
    """The first word as 16 hex digits."""
    return F.lower(F.lpad(F.hex(fp[0]), 16, "0"))
