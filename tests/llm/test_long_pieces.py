"""A text without blanks: memory by its length, and the ids of the same text in short."""

import random
import time
import tracemalloc

import numpy as np

from tessellum.llm import pieces


def test_many_characters_without_a_blank():
    words = pieces.Vocabulary.read()
    rnd = random.Random(1)
    block = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/ü語") for _ in range(4000))
    words.encode(block)
    tracemalloc.start()
    began = time.perf_counter()
    ids = words.encode(block * 150)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000 and time.perf_counter() - began < 120
    assert words.decode(np.frombuffer(ids, np.int32).tolist()) == block * 150


def test_a_long_chunk_is_segmented_like_an_exhaustive_search():
    words = pieces.Vocabulary.read()
    words._solve("a")
    known = {p: (s, i) for p, s, i in words.pieces}
    rnd = random.Random(2)
    for _ in range(40):
        text = "".join(rnd.choice(["the", "ing", "aa", "x", "語", "é", "tion", "\U0001d518"]) for _ in range(rnd.randrange(1, 30)))
        best, back = [0.0], [None]
        for end in range(1, len(text) + 1):
            ways = [(best[start] + known[text[start:end]][0], -start, known[text[start:end]][1]) for start in range(end) if text[start:end] in known]
            if text[end - 1] not in words._single:
                ways.append((best[end - 1] + words._unknown, -(end - 1) - 0.5, -1))
            total, start, i = max(ways, key=lambda w: (w[0], -w[1] * -1))
            best.append(total)
            back.append((int(-start), i))
        got = np.frombuffer(words._solve(text), np.int32).tolist()
        score, at = 0.0, 0
        spelled = {i: p for p, _, i in words.pieces}
        while got:
            i = got.pop(0)
            if i in spelled:
                score, at = score + known[spelled[i]][0], at + len(spelled[i])
            else:
                del got[: len(text[at].encode()) - 1]
                score, at = score + words._unknown, at + 1
        assert at == len(text) and abs(score - best[-1]) < 1e-6
