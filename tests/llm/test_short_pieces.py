"""Short chunks: solved in lists as solved in a ring, and kept while they are asked for."""

import random

import numpy as np

from tessellum.llm import pieces


def test_a_frequent_chunk_is_solved_once_however_many_others_come(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 100)
    solved = []
    monkeypatch.setattr(pieces.Vocabulary, "_solve", lambda self, chunk, f=pieces.Vocabulary._solve: solved.append(chunk) or f(self, chunk))
    words = pieces.Vocabulary.read()
    text = " ".join(f"often x{k}" for k in range(1000))
    ids = words.encode(text)
    assert words.decode(np.frombuffer(ids, np.int32).tolist()) == text
    assert solved.count(" often") == 1 and len(solved) == 1001
    kept = words._memo
    assert len(kept) + len(kept.older) <= 100
    assert words.encode("w" * 65) and "▁" + "w" * 65 not in kept and " " + "w" * 65 not in kept


def test_short_chunks_have_the_ids_of_the_long_way(monkeypatch):
    rnd = random.Random(3)
    some = ["the", "ing", "aa", "x", "é", "tion", "1", "...", "Ä", "ß", "$$$", "語", "\U0001d518"]
    chunks = [rnd.choice(["", " ", "   "]) + "".join(rnd.choice(some[: 11 + k % 3]) for _ in range(rnd.randrange(1, 22))) for k in range(400)]
    words = pieces.Vocabulary.read()
    short = [words._solve(c) for c in chunks]
    monkeypatch.setattr(pieces, "SHORT", 0)
    assert short == [words._solve(c) for c in chunks]
    assert words._solve("") == b""
