"""HyperMinHash near-duplicates against all pairs of whole sets."""

import random

import numpy as np
import pytest

from tessellum.llm import hyperminhash
from tessellum.llm import queries as registered
from tessellum.llm import shingles as shingles_of


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    """(doc_id, n, component, kept) of rows (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        seen = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    seen[j] = seen.get(j, 0) + 1
        for j, both in seen.items():
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, len(s), c, c is not None and d == c) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)) for c in [least.get(root(i))]), key=str)


def found(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_the_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    assert found(registered.QUERIES["op12_hyperminhash"](spark, f"/root/testdata/{sf}")) == expected(rows)


def edges(rnd):
    """Pairs on both sides of 0.85, short texts, chains, and a passage that many texts share."""
    word = lambda: f"w{rnd.randrange(100_000)}"
    texts = []
    for n in range(12, 160):
        base = [word() for _ in range(n)]
        cut = rnd.randrange(0, max(2, n // 7))
        texts += [base, base[: len(base) - cut] + [word() for _ in range(cut)], base[cut:], base + [word() for _ in range(cut)]]
    for n in range(1, 12):
        base = [word() for _ in range(n)]
        texts += [base, [*base, word()], base[1:], base[::-1], base]
    chain = [word() for _ in range(90)]
    for _ in range(60):
        chain = chain[2:] + [word(), word()]
        texts.append(chain)
    passage = [word() for _ in range(60)]
    texts += [[word() for _ in range(rnd.randrange(5, 40))] + passage for _ in range(80)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [False, True])
def test_edges(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(hyperminhash, "SHARE", 5)
        monkeypatch.setattr(hyperminhash, "TILE", 7)
        monkeypatch.setattr(hyperminhash, "BLOCK", 6)
        monkeypatch.setattr(shingles_of, "PARTNERS", 4)
    rows = edges(random.Random(4))
    assert found(hyperminhash.near_duplicates(frame(spark, rows))) == expected(rows)


@pytest.mark.parametrize("with_base", [True, False])
def test_a_group_of_variants_that_differ_from_each_other_more_than_from_their_origin(spark, with_base, monkeypatch):
    monkeypatch.setattr(hyperminhash, "TILE", 50)
    monkeypatch.setattr(hyperminhash, "BLOCK", 40)
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(100_000)}" for _ in range(200)]
    rows = [(500, " ".join(base))] if with_base else []
    for i in range(200):
        text = list(base)
        for _ in range(rnd.choice([1, 3, 4, 5, 6])):
            text[rnd.randrange(200)] = f"x{rnd.randrange(100_000)}"
        rows.append((i, " ".join(text)))
    assert found(hyperminhash.near_duplicates(frame(spark, rows))) == expected(rows)


def test_nulls_blanks_repeats_long_texts_clashing_columns_and_empty_tables(spark, docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    more = docs.selectExpr("*", "1 as k1", "'x' as sketch", "doc_id as id", "text as component")
    assert found(hyperminhash.near_duplicates(more)) == expected(rows)
    assert found(hyperminhash.near_duplicates(none)) == []
    blank = [(3, None), (2, ""), (2, " \t"), (None, None), (None, "a b c"), (None, "A b  C"), (7, "a b c d")]
    assert found(hyperminhash.near_duplicates(frame(spark, blank))) == expected(blank)


def test_registers_are_the_least_hashes_in_short():
    rnd = np.random.default_rng(3)
    for n in (1, 50, 5000):
        h = np.unique(rnd.integers(0, 2**64, n, np.uint64))
        got = hyperminhash.sketch(h.view(np.int64))
        for b in range(hyperminhash.REGISTERS):
            mine = [int(x) >> 7 for x in h if int(x) % 128 == b]
            if not mine:
                assert got[b] == 0
                continue
            bits = f"{min(mine):057b}"
            zeros = len(bits) - len(bits.lstrip("0"))
            after = (bits.lstrip("0")[1:] + "0" * 10)[:10]
            assert got[b] == ((zeros + 1) << 10 | int(after, 2))


def test_estimates_are_near_and_free_of_chance():
    rnd = np.random.default_rng(5)
    for similarity, n, m in ((0.85, 400, 400), (0.5, 3000, 3000), (0.0, 60_000, 60_000), (0.2, 1000, 2000)):
        guesses = []
        for _ in range(30):
            both = int(similarity * (n + m) / (1 + similarity))
            h = rnd.permutation(np.unique(rnd.integers(0, 2**64, n + m - both, np.uint64)))
            x, y = h[:n], np.concatenate([h[:both], h[n:]])
            guesses.append(hyperminhash.estimate(hyperminhash.sketch(x.view(np.int64)), hyperminhash.sketch(y.view(np.int64)), np.array(n), np.array(m))[0])
        assert abs(np.mean(guesses) - similarity) < 0.03


def test_registers_of_disjoint_sets_agree_as_often_as_the_correction_says(monkeypatch):
    monkeypatch.setattr(hyperminhash, "MANTISSA", 2)
    rnd = np.random.default_rng(6)
    for n, m in ((20_000, 30_000), (2000, 40_000), (600, 600)):
        agree = 0
        for _ in range(100):
            x, y = (hyperminhash.sketch(rnd.integers(0, 2**64, k, np.uint64).view(np.int64)) for k in (n, m))
            agree += ((x == y) & (x != 0)).sum()
        chance = float(hyperminhash.by_chance(np.array(n), np.array(m)))
        assert 0.85 * chance < agree / 12_800 < 1.15 * chance
