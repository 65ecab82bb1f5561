"""Codes and codebooks against Lloyd's rounds in plain integers, every distance computed."""

import hashlib
import math
import random
import struct

import numpy as np
import pytest

from tessellum.llm import quantize
from tessellum.llm import queries as registered

single = lambda x: struct.unpack("f", struct.pack("f", x))[0]


def expected(rows, parts=8, count=16, rounds=6):
    """(id, code, error, label_error, sha256) of rows (id, vector, label)."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    longest = max(len(v) for _, v, _ in kept)
    width = -(-longest // parts)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(4096 * x) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for v in whole] for p in range(parts)]
    books = [vectors[:count] for vectors in cut]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e, strict=True))
    nearest = lambda x, book: min((far(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for x in cut[p]:
                held[nearest(x, books[p])[1]].append(x)
            books[p] = [[sum(c) // len(h) for c in zip(*h, strict=True)] if h else e for h, e in zip(held, books[p], strict=True)]
    best = [[nearest(cut[p][i], books[p]) for p in range(parts)] for i in range(len(kept))]
    errors = [sum(d for d, _ in b) for b in best]
    labels = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        labels[lab] = labels.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in b), e, labels[lab], sha) for (i, _, lab), b, e in zip(kept, best, errors, strict=True)), key=str)


def found(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_the_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    assert found(registered.QUERIES["op13_codes"](spark, f"/root/testdata/{sf}")) == expected(rows)


def test_nulls_repeats_ties_ragged_and_large_vectors(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, *range(40)]), [single(rnd.choice([-0.5, 0.0, 0.25, 0.5, -1e-9]) * rnd.choice([1, 1, 1, 400])) for _ in range(rnd.choice([16, 16, 16, 13, 3, 0]))], rnd.choice([None, 1, 2])) for _ in range(300)]
    rows += rows[:50]
    bad = [(1, None, 1), (2, [1.0, None], 1), (3, [float("nan")] * 16, 1), (4, [float("-inf")] * 16, None)]
    assert found(quantize.digest(table(spark, rows + bad).repartition(5))) == expected(rows)
    assert found(quantize.digest(table(spark, bad))) == []
    assert found(quantize.digest(table(spark, rows).limit(0))) == []
    assert found(quantize.digest(table(spark, [(7, [0.5, 0.25], None)]))) == expected([(7, [0.5, 0.25], None)])
    assert found(quantize.digest(table(spark, [(7, [], None), (8, [], None)]))) == expected([(7, [], None), (8, [], None)])


def test_numbers_beyond_the_exact_range_of_doubles(spark):
    rnd = random.Random(4)
    rows = [(k, [rnd.choice([-1, 1]) * rnd.uniform(10_000, 30_000) for _ in range(16)], k % 3) for k in range(200)]
    assert found(quantize.digest(table(spark, rows, "double"))) == expected(rows)
    huge = [(k, [1e300 if k % 2 else -1e300, *[0.0] * 15], 1) for k in range(40)]
    codes, books = quantize.compress(table(spark, huge, "double"))
    assert books.entries.max() == quantize.limit(16) and codes.count() == 40


def test_groups_that_bounds_leave_out_are_not_scanned_and_nothing_changes():
    rnd = np.random.default_rng(1)
    centres = rnd.integers(-3000, 3000, (16, 8))
    x = centres[rnd.integers(0, 16, 5000)] + rnd.integers(-200, 200, (5000, 8))
    entries, of = x[:16].copy(), quantize.groups(x[:16])
    assert len(set(of.tolist())) > 1
    own, _, bounds = quantize.first_assignment(x, entries, of)
    computed = []
    for _ in range(6):
        new = np.stack([x[own == k].sum(0) // max(1, (own == k).sum()) if (own == k).any() else entries[k] for k in range(16)])
        far = np.sqrt(((new - entries) ** 2).sum(1)) * (1 + 1e-6)
        entries = new
        own, best, bounds, scanned = quantize.next_assignment(x, entries, of, np.array([far[of == g].max() for g in range(of.max() + 1)]), own, bounds)
        whole = ((x[:, None] - entries) ** 2).sum(2)
        assert (own == whole.argmin(1)).all() and (best == whole.min(1)).all()
        for g in range(of.max() + 1):
            others = np.where(own[:, None] == np.arange(16), np.iinfo(np.int64).max, whole)[:, of == g].min(1)
            assert (bounds[:, g].astype(float) <= np.sqrt(others.astype(float))).all()
        computed.append(scanned)
    assert computed[-1] < 16 * len(x) / 3


def test_decoded_vectors_are_the_entries_and_near(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    codes, books = quantize.compress(df)
    whole = {r.vec_id: r.embedding for r in df.collect()}
    errors = {r.id: r.error for r in codes.collect()}
    for r in quantize.decoded(codes, books).collect():
        x = np.floor(4096 * np.array(whole[r.id]))
        assert int(((x - 4096 * np.array(r.vector)) ** 2).sum()) == errors[r.id]
