"""Product quantization of vectors: codebooks by Lloyd's rounds with Yinyang bounds, in integers.

Each part position of the vectors has a codebook. Its entries are put in groups once; each part of a vector keeps the
entry it has and, for each group, a lower bound on its distance to the group's other entries. In a round the bounds drop by
the farthest that an entry of the group has moved, and only the groups whose bound isn't above the distance to the part's own
entry are scanned. Distances are integers, so what is scanned, ties included, is decided exactly; bounds are rounded down.

A round is one pass over a Parquet table in the shared folder that holds vectors and bounds; it writes the next one, with a row of
partial sums for each task, and the one before is deleted. Only codebooks and their sums come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import HEAVY, removed, shared_folder

#: Entries of a group, about.
OF_GROUP = 4
#: Numbers below this are integers in float64 without a loss.
EXACT = 1 << 52


class Codebooks(NamedTuple):
    """entries: (parts, entries, width) integers of `scale` times a component; length: components of a vector."""

    entries: np.ndarray
    scale: int
    length: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def limit(length: int) -> int:
    """Integers of larger size are taken as this one, so that the distance of two vectors of that length fits a long."""
    return int((2**63 / (4 * max(1, length))) ** 0.5) - 1


def integers(vectors: pa.ListArray, length: int, scale: int) -> np.ndarray:
    """floor(scale * x), a row for each vector; a shorter vector is filled up with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), length), np.int64)
    most = limit(length)
    x = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out[np.arange(length) < sizes[:, None]] = np.clip(x, -most, most).astype(np.int64)
    return out


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows to all entries, exact."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * int(most) ** 2 * x.shape[1] < EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


def groups(entries: np.ndarray) -> np.ndarray:
    """A group's number for each entry: seeds far from each other, then a few rounds of means."""
    count = max(1, len(entries) // OF_GROUP)
    x = entries.astype(np.float64)
    seeds = [0]
    far = ((x - x[0]) ** 2).sum(1)
    for _ in range(count - 1):
        seeds.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[seeds[-1]]) ** 2).sum(1))
    means = x[seeds]
    for _ in range(5):
        of = ((x[:, None] - means) ** 2).sum(2).argmin(1)
        means = np.stack([x[of == g].mean(0) if (of == g).any() else means[g] for g in range(count)])
    return of


def _lower(squared: np.ndarray) -> np.ndarray:
    """Roots, rounded down to float32."""
    return np.nextafter(np.sqrt(squared.astype(np.float64)).astype(np.float32), np.float32(-np.inf))


def first_assignment(x: np.ndarray, entries: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, squared distance, lower bound a group) of each row, all entries scanned."""
    d = distances(x, entries)
    own = d.argmin(1)
    rows = np.arange(len(x))
    best = d[rows, own]
    d[rows, own] = np.iinfo(np.int64).max
    bounds = np.stack([_lower(d[:, of == g].min(1, initial=np.iinfo(np.int64).max)) for g in range(int(of.max()) + 1)], axis=1)
    return own, best, bounds


def next_assignment(x: np.ndarray, entries: np.ndarray, of: np.ndarray, moved: np.ndarray, own: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same from the round before, and how many distances were computed. moved: the farthest move of an entry a group."""
    # of two roundings, each is undone by one step down
    bounds = np.nextafter(bounds - moved.astype(np.float32), np.float32(-np.inf))
    was = own
    was_at = ((x - entries[own]) ** 2).sum(1)
    asks = bounds <= np.sqrt(was_at.astype(np.float64))[:, None] * (1 + 1e-9)
    scanned, own, best = len(x), own.copy(), was_at.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for g in range(bounds.shape[1]):
        rows, here = np.flatnonzero(asks[:, g]), np.flatnonzero(of == g)
        if not len(rows) or not len(here):
            continue
        d = distances(x[rows], entries[here])
        scanned += d.size
        found.append((rows, here, d))
        nearest = d.argmin(1)
        at, index = d[np.arange(len(rows)), nearest], here[nearest]
        wins = (at < best[rows]) | ((at == best[rows]) & (index < own[rows]))
        best[rows[wins]], own[rows[wins]] = at[wins], index[wins]
    for rows, here, d in found:
        g = of[here[0]]
        others = np.where(here[None, :] == own[rows][:, None], np.iinfo(np.int64).max, d)
        bounds[rows, g] = _lower(others.min(1))
    # an entry given up joins its group's bound, if that group wasn't scanned
    left = np.flatnonzero(was != own)
    bounds[left, of[was[left]]] = np.minimum(bounds[left, of[was[left]]], _lower(was_at[left]))
    return own, best, bounds, scanned


class _Round(NamedTuple):
    """What a task is to know: the codebooks, their groups, and how far entries have moved; moved is None in the first round."""

    books: Codebooks
    of: list[np.ndarray]
    moved: list[np.ndarray] | None


def _assigned(x: np.ndarray, step: _Round, own: np.ndarray | None, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries, squared distances, bounds) of whole vectors, part by part."""
    parts, width = step.books.entries.shape[0], step.books.entries.shape[2]
    most = max(int(of.max()) for of in step.of) + 1
    owns, errors = np.empty((len(x), parts), np.uint8), np.empty((len(x), parts), np.int64)
    lower = np.zeros((len(x), parts, most), np.float32)
    for p in range(parts):
        part, entries, of = x[:, p * width : (p + 1) * width], step.books.entries[p], step.of[p]
        count = int(of.max()) + 1
        if step.moved is None or own is None or bounds is None:
            owns[:, p], errors[:, p], lower[:, p, :count] = first_assignment(part, entries, of)
        else:
            owns[:, p], errors[:, p], lower[:, p, :count], _ = next_assignment(part, entries, of, step.moved[p], own[:, p].astype(np.int64), bounds[:, p, :count])
    return owns, errors, lower


def _binary(x: np.ndarray) -> pa.Array:
    """A row's bytes as one binary value."""
    data = np.ascontiguousarray(x)
    size = data.nbytes // max(1, len(data))
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1) * size).astype(np.int32)), pa.py_buffer(data)])


def _array(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return (np.frombuffer(data, kind) if data else np.zeros(0, kind)).reshape(len(column), *shape)


_SLICE = 4096


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            yield batch.slice(at, _SLICE)


def _step(rows: DataFrame, step: _Round, folder: str) -> DataFrame:
    """Writes and reads again (id, label, x, own, bounds, sums) after one round; sums is a task's, on a row of its own."""
    parts, entries, width = step.books.entries.shape
    most = max(int(of.max()) for of in step.of) + 1
    length, scale = step.books.length, step.books.scale
    given = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    raw = "x" not in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        kinds: tuple[pa.DataType, pa.DataType] | None = None
        for batch in _pieces(batches):
            n = batch.num_rows
            if raw:
                x, own, bounds = integers(batch["vector"], length, scale), None, None
            else:
                x, own, bounds = _array(batch["x"], np.int32, length).astype(np.int64), _array(batch["own"], np.uint8, parts), _array(batch["bounds"], np.float32, parts, most)
            own, _, bounds = _assigned(x, step, own, bounds)
            for p in range(parts):
                np.add.at(sums[p], own[:, p], x[:, p * width : (p + 1) * width])
                counts[p] += np.bincount(own[:, p], minlength=entries)
            kinds = batch["id"].type, batch["label"].type
            empty = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], _binary(x.astype(np.int32)), _binary(own), _binary(bounds), empty], _NAMES)
        if kinds is not None:
            whole = pa.array([np.concatenate([counts.ravel(), sums.ravel()])], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), *[pa.nulls(1, pa.binary())] * 3, whole], _NAMES)

    rows.mapInArrow(run, f"id {given[0]}, label {given[1]}, x binary, own binary, bounds binary, sums array<long>").write.option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.parquet(folder)


_NAMES = ["id", "label", "x", "own", "bounds", "sums"]


def _moved(state: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks of the means of what state has assigned; an entry without a part stays."""
    place = state.where("sums is not null").select(F.posexplode("sums").alias("at", "value"))
    total = {r["at"]: int(r["value"]) for r in place.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    parts, entries, width = books.entries.shape
    new = books.entries.copy()
    for p in range(parts):
        for e in range(entries):
            count = total[p * entries + e]
            if count:
                at = parts * entries + (p * entries + e) * width
                new[p, e] = [total[at + k] // count for k in range(width)]
    return books._replace(entries=new)


def _usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(id, label, vector) of the rows whose vector is there and has finite components only."""
    label: Column = F.lit(None).cast("int") if label_col is None else F.col(label_col)
    some = rows.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return some.where(F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def _round(books: Codebooks, of: list[np.ndarray], before: Codebooks | None) -> _Round:
    if before is None:
        return _Round(books, of, None)
    far = np.sqrt(((books.entries - before.entries).astype(np.float64) ** 2).sum(2)) * (1 + 1e-6)
    return _Round(books, of, [np.array([far[p][of[p] == g].max(initial=0.0) for g in range(int(of[p].max()) + 1)]) for p in range(len(of))])


def compress(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code, error) of each row with a usable vector, and the codebooks; None instead of them if there is no such row.

    Rows whose vector is null or holds a null or a number that isn't finite are left out. A component x is floor(scale * x).
    Vectors are cut in `parts` equal parts; all have the length of the longest, rounded up to a multiple of `parts`, shorter
    ones being filled up with zeros. Integers so large that a distance would not fit a long are taken as the largest that do
    (see limit()). Entries start as the rows of the least ids, at most `entries`, null ids last, equal ids by their vectors'
    components; with fewer rows there are fewer entries. Each of the rounds assigns every part to its nearest entry, of equally
    near ones the first, and replaces an entry by the floor of the mean of its parts. code: two hex digits a part. error: the
    squared distances to the final entries, added up. Repeated rows count each; extra columns don't matter; an empty table gives
    an empty one. Bounds and vectors are in a table in the shared folder, so lost executors repeat their tasks only.
    """
    spark = rows.sparkSession
    usable = _usable(rows, id_col, vector_col, label_col)
    longest = usable.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return usable.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    width = -(-longest // parts)
    first = usable.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    start = integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), width * parts, scale)
    books = Codebooks(np.stack([start[:, p * width : (p + 1) * width] for p in range(parts)]), scale, width * parts)
    of = [groups(e) for e in books.entries]
    state, before, folders = usable, None, []
    for _ in range(rounds):
        folders.append(shared_folder(spark))
        state = _step(state, _round(books, of, before), folders[-1])
        before, books = books, _moved(state, books)
        if len(folders) > 1:
            removed(spark, folders.pop(0))
        state = state.where("x is not null")
    final = _round(books, of, before)
    most = max(int(g.max()) for g in of) + 1
    raw = "x" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            if raw:
                own, error, _ = _assigned(integers(batch["vector"], width * parts, scale), final, None, None)
            else:
                x = _array(batch["x"], np.int32, width * parts).astype(np.int64)
                own, error, _ = _assigned(x, final, _array(batch["own"], np.uint8, parts), _array(batch["bounds"], np.float32, parts, most))
            codes = [own[i].tobytes().hex() for i in range(len(own))]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(codes, pa.string()), pa.array(error.sum(1))], ["id", "label", "code", "error"])

    given = state.schema["id"].dataType.simpleString(), state.schema["label"].dataType.simpleString()
    folder = shared_folder(spark)
    state.mapInArrow(run, f"id {given[0]}, label {given[1]}, code string, error long").write.option("compression", "zstd").parquet(folder)
    for old in folders:
        removed(spark, old)
    return spark.read.parquet(folder), books


def decoded(codes: DataFrame, books: Codebooks) -> DataFrame:
    """codes (id, code) -> (id, vector): each part's entry, over the scale; a null code gives null."""
    table = books.entries.astype(np.float64) / books.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [None if c is None else table[np.arange(len(table)), np.frombuffer(bytes.fromhex(c), np.uint8)].ravel().tolist() for c in batch["code"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(vectors, pa.list_(pa.float64()))], ["id", "vector"])

    return codes.select("id", "code").mapInArrow(run, f"id {codes.schema['id'].dataType.simpleString()}, vector array<double>")


def digest(rows: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256); label_error is the error of all rows of that label, null being one."""
    codes, books = compress(rows)
    labels = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    few = labels.count() <= HEAVY
    labels = labels.withColumnRenamed("label", "of")
    joined = codes.join(F.broadcast(labels) if few else labels, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit("" if books is None else books.sha256()).alias("codebooks_sha256"))
