"""The pipeline's near-duplicates against brute force."""

import random

import pytest

from tessellum.llm import shingles as shingles_of
from tessellum.llm import simhash

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def least_of_groups(texts):
    """Ids that stand for the groups that pairs of 0.8 or more join."""
    sets, parent = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {root(k) for k in sets}


def edges():
    """Texts on both sides of 0.8, chains of near copies, and passages that two texts repeat."""
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(100_000)}"
    texts = []
    for n in range(40, 140):
        base = [word() for _ in range(n)]
        cut = rnd.randrange(n // 12, n // 6)
        texts += [base, base[:-cut] + [word() for _ in range(cut)], base[cut:]]
    chain = [word() for _ in range(80)]
    for k in range(30):
        chain = chain[2:] + [word(), word()]
        texts.append(chain)
    passage = [word() for _ in range(30)]
    texts += [[word() for _ in range(60)] + passage * 12 for _ in range(4)]
    return {i: " ".join(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("table", ["edges", "documents"])
def test_near_duplicates_equal_brute_force(spark, table):
    texts = edges() if table == "edges" else {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.without_near_duplicates(docs).collect()} == least_of_groups(texts)


def test_parts_of_a_full_slice_value_lose_nothing(spark, monkeypatch):
    texts = edges()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(simhash, "TILE", 8)
    assert {r.doc_id for r in simhash.without_near_duplicates(docs).collect()} == least_of_groups(texts)


def test_columns_of_any_name_and_a_null_id_that_links_two_others(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, 6), (2, "a b c", 7, 8), (3, "x", 1, 1)], "doc_id long, text string, row_1 long, _row_hash long")
    assert {tuple(r) for r in simhash.without_near_duplicates(docs).collect()} == {(1, "a b c", 5, 6), (3, "x", 1, 1)}
    rows = [(1, [0]), (None, [15]), (3, [255]), (4, [255 << 20])]
    fps = spark.createDataFrame(rows, "doc_id long, fp array<long>")
    simple = lambda *_: fps
    with pytest.MonkeyPatch.context() as m:
        m.setattr(simhash, "with_fingerprints", simple)
        assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(fps).collect()} == {(1, 1), (None, 1), (3, 1), (4, 4)}


def test_a_group_around_one_text_with_members_on_both_sides_of_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(shingles_of, "PARTNERS", 4)
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(100_000)}" for _ in range(150)]
    texts = {}
    for i in range(160):
        text = list(base)
        for _ in range(i % 8):
            text[rnd.randrange(150)] = f"x{rnd.randrange(100_000)}"
        texts[i] = " ".join(text)
    docs = spark.createDataFrame(list(texts.items())[1:], "doc_id long, text string")
    assert {r.doc_id for r in simhash.without_near_duplicates(docs).collect()} == least_of_groups({k: v for k, v in texts.items() if k})
