"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the vocabulary's pieces reads a text once. At each position its output links give
all pieces that end there, longest first, and each relaxes the best score of a segmentation up to that position:
Viterbi in the same pass. A character that is no piece costs the least score less UNKNOWN, and is spelled in byte
pieces. Pieces can't cross from a letter to a space or touch a line break (checked when the vocabulary is read),
so a text falls into chunks there, and each worker keeps the short chunks that it solved or met of late.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 10.0
#: Solved chunks that a worker keeps, at most.
MEMO = 300_000
#: Characters of a chunk that is kept, and solved in lists as long as itself.
SHORT = 64
_CHUNKS = re.compile(r"\n| *[^ \n]+| +")


class _Solved(dict):
    """The ids of chunks, solved when they are first asked for. When half of MEMO are here they become the older ones, of which those asked for come back and the others go."""

    def __init__(self, solve: Callable[[str], bytes]) -> None:
        self.solve, self.older = solve, {}

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > SHORT:
            return self.solve(chunk)
        found = self.older.get(chunk)
        if found is None:
            found = self.solve(chunk)
        if len(self) >= MEMO // 2:
            self.older = dict(self)
            self.clear()
        self[chunk] = found
        return found


@dataclass
class Vocabulary:
    """Pieces of a model: (text with MARK for a space, score, id); the id of each byte; the bytes of each id."""

    pieces: list[tuple[str, float, int]]
    byte_ids: list[int]
    spelled: list[bytes]
    crossing: bool
    _automaton: object = field(default=None, repr=False)
    _memo: _Solved | None = field(default=None, repr=False)

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, spelled, byte_ids = [], [], [-1] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                spelled.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                spelled.append(b"")
            else:
                pieces.append((piece, model.get_score(i), i))
                spelled.append(piece.replace(MARK, " ").encode())
        if -1 in byte_ids:
            raise ValueError("the model has no byte pieces, so it can't spell unknown characters")
        return cls(pieces, byte_ids, spelled, any(re.search(f"[^{MARK}]{MARK}|\n", p) for p, _, _ in pieces))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "_memo": None}

    def _solve(self, chunk: str) -> bytes:
        """The ids of one chunk's best segmentation, as int32 bytes; of equally good last pieces the longest.

        The automaton gives its matches in the order of their ends, and each is relaxed as it comes: scores are kept for as
        many positions as the longest piece has characters, and six bytes a position say where its best piece began.
        """
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for piece, score, i in self.pieces:
                self._automaton.add_word(piece, (len(piece), score, i))
            self._automaton.make_automaton()
            self._unknown = min(score for _, score, _ in self.pieces) - UNKNOWN
            self._single = {p for p, _, _ in self.pieces if len(p) == 1}
            self._longest = max(len(p) for p, _, _ in self.pieces)
        text = chunk.replace(" ", MARK)
        if len(text) <= SHORT and self._single.issuperset(text):
            return self._solve_short(text)
        n, ring, unknown, single = len(text), self._longest + 2, self._unknown, self._single
        best = [-math.inf] * ring
        best[0] = 0.0
        piece_of, length_of = array("i", bytes(4 * (n + 1))), array("H", bytes(2 * (n + 1)))
        now = 0  # the character whose matches are being relaxed

        def close(upto: int) -> None:
            """A character that is no piece may stand for itself, once all matches that end at it are known."""
            for k in range(now, upto):
                after = (k + 1) % ring
                if text[k] not in single and best[k % ring] + unknown > best[after]:
                    best[after], piece_of[k + 1], length_of[k + 1] = best[k % ring] + unknown, -1, 1
                best[(k + 2) % ring] = -math.inf

        for end, (length, score, i) in self._automaton.iter(text):
            if end > now:
                close(end)
                now = end
            total = best[(end + 1 - length) % ring] + score
            if total > best[(end + 1) % ring]:
                best[(end + 1) % ring], piece_of[end + 1], length_of[end + 1] = total, i, length
        close(n)
        ids = array("i")
        while n:
            start, i = n - length_of[n], piece_of[n]
            if i >= 0:
                ids.append(i)
            else:
                ids.extend(self.byte_ids[b] for b in reversed(text[start:n].encode()))
            n = start
        ids.reverse()
        return ids.tobytes()

    def _solve_short(self, text: str) -> bytes:
        """The same for a short text of which each character is a piece, so that a piece ends everywhere."""
        n = len(text)
        best, last = [-math.inf] * n, [None] * n
        best.append(0.0)  # before the first character, at -1
        for end, match in self._automaton.iter(text):
            length, score, _ = match
            total = best[end - length] + score
            if total > best[end]:
                best[end], last[end] = total, match
        ids, end = [], n - 1
        while end >= 0:
            length, _, i = last[end]
            ids.append(i)
            end -= length
        return array("i", ids[::-1]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as int32 bytes. A literal MARK is spelled in bytes, so that decoding gives it back; the empty text has no ids."""
        if not text:
            return b""
        if self._memo is None:
            self._memo = _Solved(self._solve)
        out = []
        for k, part in enumerate((" " + text).split(MARK)):
            if k:
                out.append(np.array([self.byte_ids[b] for b in MARK.encode()], np.int32).tobytes())
            out.extend(map(self._memo.__getitem__, [part] if self.crossing and part else _CHUNKS.findall(part)))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids of control pieces nothing."""
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str = MODEL) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens long, exact boolean), a row for each row of docs.

    exact: decoding the ids gave the text again. Null text has null in all three; empty text has no ids. Repeated rows
    each get their row, an empty table gives an empty one; only the two columns named are read. Of equally good last
    pieces the longest wins. A very long text is taken whole, by chunks of words; one without blanks is one chunk, for which
    a task holds its characters, six bytes for each, and its ids. The model's file is
    read on the driver, and its pieces (under 2 MB) are sent to each worker once.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = known.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                found, exact = [], []
                for text in batch["text"].to_pylist():
                    ids = None if text is None else vocabulary.encode(text)
                    found.append(ids)
                    exact.append(None if text is None else vocabulary.decode(np.frombuffer(ids, np.int32).tolist()) == text)
                sizes = np.array([len(x) // 4 if x is not None else 0 for x in found], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                null = pa.array([x is None for x in found])
                values = pa.array(np.frombuffer(b"".join(x for x in found if x), np.int32))
                ids = pa.ListArray.from_arrays(offsets, values, mask=null)
                n = pa.array([None if x is None else len(x) // 4 for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch["doc_id"], ids, n, pa.array(exact, pa.bool_())], ["doc_id", "ids", "n_tokens", "exact"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, exact boolean")


def decode(encoded: DataFrame, ids_col: str = "ids", *, model: str = MODEL, text_col: str = "text") -> DataFrame:
    """encoded with a column text_col, the text of its ids; null ids give null."""
    known = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(model))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda ids: None if ids is None else known.value.decode(np.asarray(ids).tolist()))

    return encoded.withColumn(text_col, run(F.col(ids_col)))
