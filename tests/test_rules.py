"""Many rules at once against a search of each, and the edges."""

import random

from tessellum.operators import rules


def test_ten_thousand_rules_in_one_pass(spark):
    rnd = random.Random(3)
    phrases = [f"W{rnd.randrange(10**rnd.randrange(1, 7))}" for _ in range(10_000)]
    texts = [None, "", "nothing"] + [" ".join(f"w{rnd.randrange(10**rnd.randrange(2, 8))}" for _ in range(rnd.randrange(1, 30))).upper() for _ in range(300)]
    rows = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "id long, text string, _x int")
    got = {r.id: r.rule for r in rules.first_rule(rows, "text", phrases).collect()}
    low = [p.lower() for p in phrases]
    assert got == {k: next((i for i, p in enumerate(low) if p in t.lower()), None) if t else None for k, t in enumerate(texts)}


def test_first_rule_wins_and_rows_keep_their_columns(spark):
    rows = spark.createDataFrame([(1, "A WALL COVERING on the wall", [1]), (2, "roof", None), (3, "x", [2])], "id long, text string, more array<int>")
    got = sorted(tuple(r) for r in rules.labelled(rows, "text", rules.CATEGORIES, "category").collect())
    assert got == [(1, "A WALL COVERING on the wall", [1], "improvement"), (2, "roof", None, "structural"), (3, "x", [2], None)]
    assert rules.first_rule(rows, "text", ["", "wall", "Wall"]).where("rule = 1").count() == 1
    assert rules.first_rule(rows, "text", []).where("rule is null").count() == 3
    assert rules.first_rule(rows.limit(0), "text", ["a"]).count() == 0
