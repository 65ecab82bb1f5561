"""Repair of conversations against every edit script that can be the cheapest, and against a uniform-cost search."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from tessellum.llm import dialogue
from tessellum.llm import queries as registered

WHITE = " \t\n\v\f\r"
RIGHT = re.compile(r"(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    """(role, text, must go, cut) of rows in order, and the counts."""
    seen, out, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        shown = text.strip(WHITE)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
        seen.add((role, text))
        n[fault] = n.get(fault, 0) + 1
        out.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    return out, n


def every_script(marked):
    """Least (cost, audit, kept) over all scripts; deleting all costs two a row, which bounds the inserts."""
    best, most = (99, "", []), 2 * len(marked) // 5
    choices = [[("D", None, 2)] + ([] if go else [("K", role, 5 * cut), ("R", "user", 1 + 5 * cut), ("R", "assistant", 1 + 5 * cut)]) for role, _, go, cut in marked]
    for edits in itertools.product(*choices):
        for count in range(most + 1):
            for gaps in itertools.combinations_with_replacement(range(len(marked) + 1), count):
                for names in itertools.product(("user", "assistant"), repeat=count):
                    cost, audit, kept, put = 5 * count + sum(e[2] for e in edits), "", [], list(zip(gaps, names, strict=True))
                    for k in range(len(marked) + 1):
                        for at, name in put:
                            if at == k:
                                audit, kept = audit + "I", [*kept, (name, "")]
                        if k < len(marked):
                            audit += edits[k][0]
                            if edits[k][1] is not None:
                                kept = [*kept, (edits[k][1], marked[k][1])]
                    if (cost, audit) < best[:2] and all(r for r, _ in kept) and RIGHT.fullmatch("".join(r[0] for r, _ in kept)):
                        best = (cost, audit, kept)
    return best


def cheapest_first(marked):
    """The same by a search in the order of (cost, audit)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, closed = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, last, kept = heapq.heappop(heap)
        if k == len(marked) and last in ("", "a"):
            return cost, audit, list(kept)
        if (k, last) in closed:
            continue
        closed.add((k, last))
        for symbol, name in NAMES.items():
            if (last, symbol) in step:
                heapq.heappush(heap, (cost + 5, audit + "I", k, symbol, (*kept, (name, ""))))
        if k < len(marked):
            role, text, go, cut = marked[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, last, kept))
            if not go:
                if (last, role[:1]) in step:
                    heapq.heappush(heap, (cost + 5 * cut, audit + "K", k + 1, role[:1], (*kept, (role, text))))
                for symbol, name in NAMES.items():
                    if (last, symbol) in step:
                        heapq.heappush(heap, (cost + 1 + 5 * cut, audit + "R", k + 1, symbol, (*kept, (name, text))))


def expected(convs, solve=cheapest_first):
    out = []
    for conv_id, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marked, n = faults(rows)
        turns = [t for t, _, _ in rows if t is not None]
        cost, audit, kept = solve(marked) if rows else (0, "", [])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv_id, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=str)


def damaged(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        kept = convs.setdefault(conv_id, [])
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return convs


def found(df):
    assert df.columns == ["conv_id", *dialogue.FOUND]
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(rnd, rows):
    text = lambda: rnd.choice(["", " \t", "yes.", "no", "what?", f"w{rnd.randrange(9)}!", f"cut {rnd.randrange(9)}", "Grüße.\n "])
    return [(rnd.choice([None, *range(12)]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User"]), text()) for _ in range(rows)]


def test_every_script_of_short_conversations(spark):
    rnd = random.Random(3)
    convs = {k: made(rnd, 1 + k % 5) for k in range(100)}
    docs = spark.createDataFrame([(k, *r) for k, rows in convs.items() for r in rows], "conv_id long, turn int, role string, text string")
    assert found(dialogue.repairs(docs)) == expected(convs, every_script) == expected(convs)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_the_whole_table(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").collect()]
    assert found(registered.QUERIES["op11_dialogue"](spark, f"/root/testdata/{sf}")) == expected(damaged(rows))


def test_nulls_ties_repeats_extra_columns_and_empty_tables(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, 1, 2, 3, 7]), *(None if rnd.random() < 0.1 else x for x in r)) for r in made(rnd, 120)]
    rows += rows[:30]
    docs = spark.createDataFrame([(*r, 5, "x", None) for r in rows], "conv_id long, turn int, role string, text string, copy int, first string, k1 long")
    assert found(dialogue.repairs(dialogue.damage(docs))) == expected(damaged(rows))
    assert found(dialogue.repairs(dialogue.damage(docs.limit(0)))) == []
    assert dialogue.repaired(docs.limit(0)).collect() == []


def test_only_dropped_rows_and_all_null_turns(spark):
    key = next(k for k in range(1000) if zlib.crc32(f"{k}: ".encode()) % 20 == 0)
    docs = spark.createDataFrame([(key, None, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert found(dialogue.repairs(dialogue.damage(docs))) == [(key, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert found(dialogue.repairs(docs)) == expected({key: [(None, "user", "Hi.")]})
    docs = spark.createDataFrame([(1, -(2**63), "user", "Hi."), (1, 2**63 - 1, "assistant", "Hi.")], "conv_id long, turn long, role string, text string")
    assert found(dialogue.repairs(docs))[0][1] == 2**63 - 1


@pytest.mark.parametrize("roles", [("user", "assistant"), ("human", "gpt"), ("user", "user", "assistant", "tool")])
def test_a_long_conversation_with_long_texts(spark, roles, monkeypatch):
    monkeypatch.setattr(dialogue, "LONG", 64)
    rows = [(k, roles[k % len(roles)], f"turn {k % 700} " + "x" * (500_000 if k % 1500 == 3 else 5) + ("." if k % 7 else "")) for k in range(3000)]
    docs = spark.createDataFrame([("c", *r) for r in rows], "conv_id string, turn long, role string, text string")
    assert found(dialogue.repairs(docs)) == expected({"c": rows})


def test_repaired_rows_have_the_digest(spark):
    rnd = random.Random(8)
    rows = [(rnd.randrange(12), *r) for r in made(rnd, 90)]
    docs = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {}
    for r in sorted(dialogue.repaired(docs).collect()):
        assert r.position == len(got.setdefault(r.conv_id, []))
        got[r.conv_id].append((r.edit, r.role, r.text))
    for conv_id, *_, audit, digest in found(dialogue.repairs(docs)):
        kept = got.get(conv_id, [])
        assert "".join(e for e, _, _ in kept) == audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in kept).encode()).hexdigest() == digest
        assert RIGHT.fullmatch("".join(r[0] for _, r, _ in kept))
