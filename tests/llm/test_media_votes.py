"""Votes of recordings: memory by the size of a part, and the same result however the parts are cut."""

import tracemalloc

import numpy as np
import pytest

from tessellum.llm import media


def brute(a, b):
    """The fullest offset of two recordings, of equally full ones the least, of those the negative; None without votes."""
    votes = {}
    for offset in range(-len(a) + 1, len(b)):
        s = max(0, -offset)
        n = min(len(a), len(b) - offset) - s
        x, y = a[s : s + n], b[s + offset : s + offset + n]
        votes[offset] = int((x << np.uint32(14) == y << np.uint32(14)).sum() + (x >> np.uint32(14) == y >> np.uint32(14)).sum())
    best = min(votes, key=lambda o: (-votes[o], abs(o), o))
    return best if votes[best] else None


def test_values_that_all_recordings_have_take_little_memory():
    random = np.random.default_rng(1)
    items = [random.integers(0, 8, 50).astype(np.uint32) for _ in range(300)]
    tracemalloc.start()
    found = media.align(items[:100], items, 0.0, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300_000_000
    assert {(int(q), int(r)) for q, r in zip(found[0], found[1], strict=True)} >= {(k, k) for k in range(100)}


@pytest.mark.parametrize("part", [16, 200, 1 << 21])
def test_parts_of_any_size_give_the_fullest_offset(monkeypatch, part):
    random = np.random.default_rng(2)
    items = [random.integers(0, 6, random.integers(1, 40)).astype(np.uint32) for _ in range(8)]
    items += [np.repeat(random.integers(0, 4, 5), random.integers(1, 30, 5)).astype(np.uint32) for _ in range(8)]
    items += [np.zeros(0, np.uint32), np.full(90, 7, np.uint32), np.full(40, 7, np.uint32), np.append(np.full(30, 1), np.full(60, 7)).astype(np.uint32)]
    monkeypatch.setattr(media, "PART", part)
    q, r, offset, _ = media.align(items, items, 1.0, 0)
    found = dict(zip(zip(q.tolist(), r.tolist(), strict=True), offset.tolist(), strict=True))
    for i, a in enumerate(items):
        for j, b in enumerate(items):
            best = brute(a, b) if len(a) and len(b) else None
            if best is not None:
                overlap = min(len(a), len(b) - best) - max(0, -best)
                best = best if overlap >= min(len(a), len(b)) / 2 else None
            assert found.get((i, j)) == best


def test_recordings_too_short_to_align_are_not_compared(spark, monkeypatch):
    random = np.random.default_rng(3)
    short = bytes(random.integers(0, 256, 2000).tolist())  # 13 integers
    long = bytes(random.integers(0, 256, 4000).tolist())
    rows = [(20, short), (21, short[1:]), (22, short), (40, long), (41, long[64:]), (60, b"")]
    monkeypatch.setattr(media, "align", lambda a, b, *rest, f=media.align: f(a, b, *rest) if all(len(x) >= 16 for x in a + b) else 1 / 0)
    found = {x.doc_id: x for x in media.search(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert [found[k].n_aligned for k in (20, 22, 40, 60)] == [0, 0, 1, 0] and found[40].best_id == 41 and found[22].recording_id == 20


def test_most_overlaps_are_given_up_before_all_of_their_integers_are_held_against_each_other(monkeypatch):
    random = np.random.default_rng(4)
    rows = [random.integers(0, 2**32, n).astype(np.uint32) for n in random.integers(16, 400, 300)]
    for x in rows[::3]:
        x[5:15] = 7  # all share a value, so that all pairs are voted for
    near = [x ^ (random.integers(0, 2**32, len(x)) & random.integers(0, 2**32, len(x)) & random.integers(0, 2**32, len(x))).astype(np.uint32) for x in rows[:40]]
    compared, errors = [], media._errors
    monkeypatch.setattr(media, "_errors", lambda a, b, i, j, offset, size: compared.append(len(i)) or errors(a, b, i, j, offset, size))
    q, r, offset, error = media.align(near + rows[:3], rows, 0.2, 16)
    assert {(k, k) for k in range(40)} <= set(zip(q.tolist(), r.tolist(), strict=True)) and sum(compared) <= 3 * len(q)
    monkeypatch.setattr(media, "_hopeful", lambda a, b, i, *rest: np.ones(len(i), bool))
    every = media.align(near + rows[:3], rows, 0.2, 16)
    assert sum(compared) > 1000
    held = [sorted(zip(*(x.tolist() for x in found), strict=True)) for found in ((q, r, offset, error), every)]
    assert held[0] == held[1]


def test_filters_over_many_recordings_at_once_say_the_same(monkeypatch):
    random = np.random.default_rng(5)
    items = [random.integers(0, 256, n).astype(np.uint8) for n in (0, 1, 255, 256, 1215, 1216, 1217, 1300, 5000, 0, 90_000, 3)] + [np.full(4000, 128, np.uint8)]
    calls, packed = [], media._packed
    monkeypatch.setattr(media, "_packed", lambda images: calls.append(len(images)) or packed(images))
    assert [x.tolist() for x in media.all_integers(items)] == [media.integers(x).tolist() for x in items]
    assert max(calls[:3]) > 5
