"""Chroma audio fingerprints, and a search that aligns recordings.

A recording is raw 8-bit PCM. Its spectrum is folded into 12 pitch classes a frame; filters on the integral image of
frames by pitch classes compare rectangles, and each filter's answer, quantised to two bits in Gray code, is a part
of one packed 32-bit integer a frame. Two recordings are aligned by a histogram of the offsets between all equal
halves of integers, counted by runs of one value; the share of different bits in the overlap at the fullest offset decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import checkpointed

RATE = 8000
FRAME, HOP = 256, 64
#: Frames that an integer looks at.
WIDTH = 16
#: Frames, about, that the filters go over at once.
FRAMES = 1 << 12
#: (kind, first pitch class, pitch classes, frames): a band's later against earlier half, upper against lower half, checkerboard, middle third against the rest.
FILTERS = [(kind, first, height, frames) for kind, first, height, frames in ((k, f, h, w) for k in range(4) for f, h, w in ((0, 12, 16), (0, 6, 12), (6, 6, 8), (3, 6, 6)))]
#: Of each filter, the answers that part its codes, about the quartiles over ordinary recordings.
CUTS = [
    (-0.022, -0.0, 0.02), (-0.038, -0.0, 0.035), (-0.077, -0.0, 0.076), (-0.081, -0.0, 0.078),
    (-0.595, -0.516, -0.2), (-1.203, -1.077, -0.667), (0.014, 0.129, 0.237), (0.011, 0.118, 0.232),
    (-0.039, 0.001, 0.045), (-0.047, 0.0, 0.047), (-0.078, 0.0, 0.077), (-0.087, 0.0, 0.087),
    (0.209, 0.239, 0.27), (-0.048, 0.0, 0.048), (0.698, 0.832, 0.972), (-0.101, 0.0, 0.099),
]
#: An integer votes by its lower and its upper BITS, so that a few wrong bits leave a vote.
BITS = 18
#: Rows of one side of a tile.
QUERIES, ROWS = 8192, 16384
#: Integers of one side of a tile, on average; a longer recording is taken whole.
INTEGERS = 1 << 21
#: Votes, or integers, compared in one go.
PART = 1 << 21
#: Queries of a part are fewer if the keys of their votes fit into an integer of 32 bits, which is sorted sooner.
NARROW = 1 << 31
#: Runs shorter than this are taken place by place.
LONG = 8
#: Integers, and pairs, that are held against each other in one step.
STEP, PAIRS = 16, 1 << 13

_PITCH = np.array([0, *(np.round(12 * np.log2(np.arange(1, FRAME // 2 + 1) * RATE / FRAME / 440)).astype(int) % 12)])
_FOLD = np.zeros((FRAME // 2 + 1, 12), np.float32)
_FOLD[np.arange(1, FRAME // 2 + 1), _PITCH[1:]] = 1
_HANN = np.hanning(FRAME).astype(np.float32)
#: To add up the eight bytes of an integer of 64 bits.
_EVEN, _BYTE, _FOUR, _TOP = (np.uint64(x) for x in (0x00FF00FF00FF00FF, 8, 0x0001000100010001, 48))


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by 12 pitch classes, each frame of length one, or zero if it is silent. A short recording is padded to WIDTH frames."""
    need = FRAME + (WIDTH - 1) * HOP
    x = samples.astype(np.float32) - 128
    if len(x) < need:
        x = np.concatenate([x, np.zeros(need - len(x), np.float32)])
    frames = np.ndarray(((len(x) - FRAME) // HOP + 1, FRAME), x.dtype, x, strides=(4 * HOP, 4))
    out = np.empty((len(frames), 12), np.float32)
    for at in range(0, len(frames), 4096):
        spectrum = np.fft.rfft(frames[at : at + 4096] * _HANN, axis=1)
        out[at : at + 4096] = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _FOLD
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return np.where(size > 1e-3, out / np.maximum(size, 1e-3), 0)


def integers(samples: np.ndarray) -> np.ndarray:
    """The packed integers of one recording, none for an empty one."""
    return all_integers([samples])[0]


def all_integers(recordings: list[np.ndarray]) -> list[np.ndarray]:
    """The packed integers of each recording. The filters go over the images of recordings of some FRAMES frames at once."""
    found: list[np.ndarray] = []
    images: list[np.ndarray] = []
    frames = 0
    for samples in recordings:
        images.append(chroma(samples) if len(samples) else np.zeros((0, 12), np.float32))
        frames += len(images[-1])
        if frames >= FRAMES:
            found += _packed(images)
            images, frames = [], 0
    return found + _packed(images)


def _packed(images: list[np.ndarray]) -> list[np.ndarray]:
    """Of each image of frames by pitch classes the packed integers; what the filters say across two images is left out."""
    if not images:
        return []
    ends = np.cumsum([len(image) + 1 for image in images])
    whole = np.zeros((13, ends[-1] + WIDTH))
    for image, end in zip(images, ends.tolist(), strict=True):
        whole[1:, end - len(image) : end] = image.cumsum(0, dtype=np.float64).cumsum(1).T
    n = ends[-1]

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return whole[p1, t1 : t1 + n] - whole[p1, t0 : t0 + n] - whole[p0, t1 : t1 + n] + whole[p0, t0 : t0 + n]

    packed = np.zeros(n, np.uint32)
    with np.errstate(invalid="ignore", divide="ignore"):  # across two images
        for (kind, p, h, w), cuts in zip(FILTERS, CUTS, strict=True):
            t, all_of = (WIDTH - w) // 2, area((WIDTH - w) // 2, (WIDTH + w) // 2, p, p + h)
            if kind == 0:
                part = area(t + w // 2, t + w, p, p + h)
            elif kind == 1:
                part = area(t, t + w, p + h // 2, p + h)
            elif kind == 2:
                part = area(t, t + w // 2, p, p + h // 2) + area(t + w // 2, t + w, p + h // 2, p + h)
            else:
                part = 1.5 * area(t + w // 3, t + w - w // 3, p, p + h)
            value = np.log1p(part) - np.log1p(np.maximum(all_of - part, 0))
            code = (value > cuts[0]).view(np.uint8) + (value > cuts[1]).view(np.uint8) + (value > cuts[2]).view(np.uint8)
            packed = (packed << np.uint32(2)) | (code ^ (code >> np.uint8(1)))
    return [packed[end - len(image) - 1 : end - WIDTH].copy() if len(image) else np.zeros(0, np.uint32) for image, end in zip(images, ends.tolist(), strict=True)]


def with_integers(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(doc_id, items binary: little-endian 32-bit integers), a row for each row of media; null media have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                items = [x.astype("<u4").tobytes() for x in all_integers([np.frombuffer(x.as_py() or b"", np.uint8) for x in batch["media"]])]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(items, pa.binary())], ["doc_id", "items"])

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, "doc_id long, items binary")


def _joined(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All integers after one another, and each recording's length and start in them."""
    size = np.array([len(x) for x in items], np.int64)
    return np.concatenate([np.zeros(0, np.uint32), *items]), size, np.cumsum(size) - size


def _runs(items: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(value, recording, start, length) of all runs of one value, of each integer's lower and of its upper BITS, sorted by value, then recording, then start.

    A run shorter than LONG is as many runs of one place.
    """
    x, size, begin = _joined(items)
    found = [(np.zeros(0, np.int32),) * 4]
    for high, part in ((0, x & np.uint32((1 << BITS) - 1)), (1 << BITS, x >> np.uint32(32 - BITS))):
        new = np.ones(len(x), bool)
        new[1:] = part[1:] != part[:-1]
        new[begin[size > 0]] = True
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(x)))
        at = np.flatnonzero(new | np.repeat(length < LONG, length))
        owner = (np.searchsorted(begin + size, at, "right")).astype(np.int32)
        found.append((part[at].astype(np.int32) + np.int32(high), owner, (at - begin[owner]).astype(np.int32), np.diff(np.append(at, len(x))).astype(np.int32)))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    order = columns[0].astype(np.int64) << 40 | np.arange(len(columns[0]))
    order.sort()
    order &= (1 << 40) - 1
    return tuple(c[order] for c in columns)


def _from(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo to lo + n - 1 for each of lo and n, after one another."""
    return np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)


def _within(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each of n, after one another."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _points(key: np.ndarray, q_key: np.ndarray, lo: np.ndarray, n: np.ndarray, q_length: np.ndarray, length: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, votes) of all pairs of places of runs of equal values: each of the query's with the n from lo on. long: it is long, or has a long one among those."""
    fast = ~long
    keys = [key[_from(lo[fast], n[fast])]]
    keys[0] += np.repeat(q_key[fast], n[fast])
    if long.any():
        k, n = _from(lo[long], n[long]), n[long]
        wide = length[k].astype(np.int64)
        each = np.repeat(q_length[long], n) * wide
        at, wide = _within(each), np.repeat(wide, each)
        keys.append((np.repeat(key[k] + np.repeat(q_key[long], n), each) + at % wide - at // wide).astype(key.dtype))
    keys = np.concatenate(keys)
    keys.sort()
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[new], np.diff(np.append(new, len(keys)))


def _bends(key: np.ndarray, n: np.ndarray, m: np.ndarray, span: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by where the histograms' slopes change: two runs of n and m equal values make a trapezoid.

    The place before each bend is there as well, as a slope's top may be there, and each pair's offset 0, which may be the
    least of a level top. No other place is fuller, or as full and nearer to zero.
    """
    at = np.concatenate([key - n + 1 + x for x in (0, np.minimum(n, m), np.maximum(n, m), n + m)])
    keys, where = np.unique(np.concatenate([at, at - 1, key // span * span + half]), return_inverse=True)
    one = np.ones(len(n), np.int64)
    bends = np.bincount(where[: len(at)], weights=np.concatenate([one, -one, -one, one]), minlength=len(keys))
    slope = np.cumsum(bends)  # each pair's bends sum up to zero, so the next pair begins level
    step, new = np.diff(keys, prepend=0), np.diff(keys // span, prepend=-1) != 0
    votes = np.cumsum(np.where(new, slope, np.append(0, slope[:-1]) * (step - 1) + slope))
    return keys, votes.astype(np.int64)


def _fullest(keys: np.ndarray, votes: np.ndarray, span: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, offset): each pair's fullest offset, of equally full ones the least, of those the negative. span: a power of two."""
    bits = span.bit_length() - 1
    pair, offset = keys >> bits, (keys & (span - 1)).astype(np.int64) - half
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(pair)), bool), pair[1:] != pair[:-1]]))
    # 0, -1, 1, -2 and so on, the first of them as the largest below the votes
    most = np.maximum.reduceat((votes << (bits + 1)) - (offset << 1 ^ offset >> 63), first)
    least = -most & (2 * span - 1)
    return pair[first].astype(np.int64), least >> 1 ^ -(least & 1)


def _hopeful(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, offset: np.ndarray, size: np.ndarray, most_error: float) -> np.ndarray:
    """Which overlaps don't have more wrong bits than most_error allows among the integers of their first half or so: the rest fail, whatever follows."""
    left, right = a[2][i] + np.maximum(0, -offset), b[2][j] + np.maximum(0, offset)
    # STEP integers from each place on, as one item
    whole = [np.ndarray((max(0, len(x) - STEP + 1),), f"V{4 * STEP}", np.ascontiguousarray(x, np.uint32), strides=(4,)) for x in (a[0], b[0])]
    most = most_error * 32 * size + 1
    out = np.ones(len(i), bool)
    k, wrong, done = np.arange(len(i)), np.zeros(len(i), np.int64), 0
    while len(more := np.flatnonzero(size[k] >= done + STEP)):
        k, wrong = k[more], wrong[more]
        for at in range(0, len(k), PAIRS):
            x, y = (w[p[k[at : at + PAIRS]] + done].view(np.uint64) for w, p in zip(whole, (left, right), strict=True))
            x ^= y
            each = np.bitwise_count(x).view(np.uint64)  # eight counts of up to 64 in eight bytes
            wrong[at : at + PAIRS] += ((((each & _EVEN) + (each >> _BYTE & _EVEN)) * _FOUR) >> _TOP).astype(np.int64)
        done += STEP
        fits = wrong <= most[k]
        out[k[~fits]] = False
        k, wrong = k[fits], wrong[fits]
    return out


def _errors(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Share of different bits in the overlaps, of `size` integers, of a[i] and b[j], where b's place is a's place plus offset."""
    left, right = a[2][i] + np.maximum(0, -offset), b[2][j] + np.maximum(0, offset)
    out = np.zeros(len(i))
    ends = np.cumsum(size)
    cuts = [0, *np.searchsorted(ends, np.arange(PART, ends[-1] if len(ends) else 0, PART)).tolist(), len(i)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi > lo:
            n = size[lo:hi]
            k = _within(n)
            wrong = np.bitwise_count(a[0][np.repeat(left[lo:hi], n) + k] ^ b[0][np.repeat(right[lo:hi], n) + k])
            out[lo:hi] = np.add.reduceat(wrong, np.cumsum(n) - n, dtype=np.int64)
    return out / (32 * size)


def align(queries: list[np.ndarray], rows: list[np.ndarray], most_error: float, least_overlap: int) -> tuple[np.ndarray, ...]:
    """(query, row, offset, error) of all pairs that align.

    The votes are counted in parts, each of whole pairs of recordings and of at most PART places or bends; a part with more
    is halved by queries, then by rows, and a single pair with more has a histogram of its own, as long as both recordings.
    """
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
    a, b = _joined(queries), _joined(rows)
    value, owner, place, length = _runs(rows)
    q_value, q_owner, q_place, q_length = _runs(queries)
    value = value.astype(np.int64) * len(rows) + owner
    low, high = (np.searchsorted(value, q_value.astype(np.int64) * len(rows) + x) for x in (0, len(rows)))
    order = np.flatnonzero(high > low)
    order = order[np.argsort(q_owner[order], kind="stable")]
    q_value, q_owner, q_place, q_length, low, high = (x[order] for x in (q_value, q_owner, q_place, q_length, low, high))
    half = int(max([2, *a[1].tolist()]) + max([2, *b[1].tolist()]))  # no offset, nor the place after or before one, is farther from zero
    span = 1 << (2 * half).bit_length()
    upto = np.append(0, np.cumsum(length, dtype=np.int64))
    begin = np.searchsorted(q_owner, np.arange(len(queries) + 1))
    narrow = max(1, NARROW // (len(rows) * span)) if len(rows) else 1
    keys_of = {kind: owner.astype(kind) * kind(span) + place.astype(kind) for kind in ([np.int32] if len(rows) * span <= NARROW else []) + [np.int64]}
    parts = [(0, len(queries), 0, len(rows))]
    while parts:
        q0, q1, r0, r1 = parts.pop()
        cut = slice(begin[q0], begin[q1])
        lo, hi = low[cut], high[cut]
        if (r0, r1) != (0, len(rows)):
            lo, hi = (np.searchsorted(value, q_value[cut].astype(np.int64) * len(rows) + x) for x in (r0, r1))
        n = hi - lo
        each = q_length[cut] * (upto[hi] - upto[lo])
        pairs, places = int(n.sum()), int(each.sum())
        if not pairs:
            continue
        kind = np.int32 if q1 - q0 <= narrow and np.int32 in keys_of else np.int64
        if min(places, 8 * pairs) <= PART and (q1 - q0 <= narrow or narrow == 1):
            key = keys_of[kind]
            q_key = ((q_owner[cut] - q0).astype(kind) * kind(len(rows) * span) + kind(half) - q_place[cut]).astype(kind)
            if places <= 8 * pairs:
                keys, votes = _points(key, q_key, lo, n, q_length[cut], length, each > n)
            else:
                k = _from(lo, n)
                keys, votes = _bends((np.repeat(q_key, n) + key[k]).astype(np.int64), np.repeat(q_length[cut], n).astype(np.int64), length[k].astype(np.int64), span, half)
            pair, offset = _fullest(keys, votes, span, half)
            pair += q0 * len(rows)
        elif q1 - q0 > 1:
            parts += [(q0, (q0 + q1) // 2, r0, r1), ((q0 + q1) // 2, q1, r0, r1)]
            continue
        elif r1 - r0 > 1:
            parts += [(q0, q1, r0, (r0 + r1) // 2), (q0, q1, (r0 + r1) // 2, r1)]
            continue
        else:
            bends = np.zeros(span + 1, np.int64)
            ends = np.cumsum(n)
            edges = [0, *np.searchsorted(ends, np.arange(PART, pairs, PART)).tolist(), len(n)]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                k = _from(lo[x:y], n[x:y])
                one, other = np.repeat(q_length[cut][x:y], n[x:y]).astype(np.int64), length[k].astype(np.int64)
                first = half + place[k] - np.repeat(q_place[cut][x:y], n[x:y]) - one + 1
                for where, sign in ((0, 1), (np.minimum(one, other), -1), (np.maximum(one, other), -1), (one + other, 1)):
                    bends += sign * np.bincount(first + where, minlength=span + 1)
            votes = np.cumsum(np.cumsum(bends))[:span]
            pair, offset = _fullest((q0 * len(rows) + r0) * span + np.arange(span), votes, span, half)
        i, j = pair // len(rows), pair % len(rows)
        size = np.minimum(a[1][i], b[1][j] - offset) - np.maximum(0, -offset)
        fits = (size > 0) & (size >= np.maximum(least_overlap, np.minimum(a[1][i], b[1][j]) / 2))
        i, j, offset, size = i[fits], j[fits], offset[fits], size[fits]
        fits = _hopeful(a, b, i, j, offset, size, most_error)
        i, j, offset, size = i[fits], j[fits], offset[fits], size[fits]
        error = _errors(a, b, i, j, offset, size)
        keep = error <= most_error
        found.append((i[keep], j[keep], offset[keep], error[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", *, every: int = 20, most_error: float = 0.2, least_overlap: int = 16) -> DataFrame:
    """(doc_id, n_items, recording_id, is_query, n_aligned, best_id, best_offset, best_error), a row for each row of media.

    recording_id: the least id of the rows with equal integers, whose copies are one recording. Queries are the
    recordings that an id divisible by `every` has (every=1: all); for them n_aligned counts the rows of all other
    recordings that align with theirs, and best_* is the one of least error, ties by id; offset is in frames. They are
    null for other rows. Recordings align if at most most_error of the bits differ in their overlap, which must have
    least_overlap integers and half of the shorter recording; shorter ones align with nothing but are grouped if equal.
    n_aligned is 0 and best_* null where nothing aligns. Only the fullest offset of two recordings is compared, of equally full
    ones the least. Null or empty media have no integers and align with nothing; very long ones are taken whole. Rows with a null id find themselves in their recording, and count; a recording of null ids only
    has no name and is not searched. Repeated rows each get their row; an empty table gives an empty one.

    Queries and recordings meet in tiles of QUERIES by ROWS, or of fewer if they are long, so all queries see all recordings
    that are long enough to align, no task more than a tile, and only a sum and a best a query leave it.
    """
    each = checkpointed(with_integers(media, id_col, media_col))
    asks = F.coalesce(F.pmod(F.col("doc_id"), F.lit(every)) == 0, F.lit(False))
    classes = checkpointed(each.groupBy("items").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.max(asks).alias("asks")).where("id is not null"))
    size = (F.length("items") / 4).cast("long")
    some = classes.where(size >= max(1, least_overlap))  # no overlap is longer than the shorter recording
    n, n_asks, sizes, sizes_asks = some.agg(F.count("*"), F.count_if("asks"), F.sum(size), F.sum(F.when(F.col("asks"), size))).first()
    blocks = max(1, math.ceil(n_asks / QUERIES), math.ceil((sizes_asks or 0) / INTEGERS))
    groups = max(1, math.ceil(n / ROWS), math.ceil((sizes or 0) / INTEGERS))
    block, group = F.pmod(F.xxhash64("id", F.lit("q")), F.lit(blocks)), F.pmod(F.xxhash64("id", F.lit("r")), F.lit(groups))
    all_of = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = some.where("asks").select(block.cast("int").alias("block"), all_of(groups).alias("group"), F.lit(True).alias("query"), "id", "n", "items")
    right = some.select(all_of(blocks).alias("block"), group.cast("int").alias("group"), F.lit(False).alias("query"), "id", "n", "items")

    def run(tile: pa.Table) -> pa.Table:
        query = tile["query"].to_numpy()
        ids, weight = tile["id"].to_numpy(), tile["n"].to_numpy()
        items = [np.frombuffer(x.as_py(), "<u4") for x in tile["items"]]
        a, b = np.flatnonzero(query), np.flatnonzero(~query)
        i, j, offset, error = align([items[k] for k in a], [items[k] for k in b], most_error, least_overlap) if len(a) and len(b) else (np.zeros(0, np.int64),) * 4
        i, j = a[i], b[j]
        other = ids[i] != ids[j]
        i, j, offset, error = i[other], j[other], offset[other], error[other]
        order = np.lexsort((ids[j], error, i))
        i, j, offset, error = i[order], j[order], offset[order], error[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        count = np.add.reduceat(weight[j], first) if len(first) else np.zeros(0, np.int64)
        return pa.table({"q": ids[i[first]], "n_aligned": count.astype(np.int64), "error": error[first].astype(float), "best": ids[j[first]], "offset": offset[first].astype(np.int64)})

    found = left.unionByName(right).groupBy("block", "group").applyInArrow(run, "q long, n_aligned long, error double, best long, offset long")
    best = F.min(F.struct("error", "best", "offset"))
    found = found.groupBy("q").agg(F.sum("n_aligned").alias("n_aligned"), best.alias("b"))
    named = classes.join(found, F.col("id") == F.col("q"), "left").select(
        F.col("items").alias("key"), F.col("id").alias("recording_id"), "asks", F.when(F.col("asks"), F.coalesce("n_aligned", F.lit(0))).alias("n_aligned"), "b"
    )
    out = each.join(named, each["items"] == named["key"], "left")
    return out.select(
        "doc_id", (F.length("items") / 4).cast("long").alias("n_items"), "recording_id", F.coalesce("asks", F.lit(False)).alias("is_query"), "n_aligned",
        F.col("b.best").alias("best_id"), F.col("b.offset").alias("best_offset"), F.col("b.error").alias("best_error"),
    )
