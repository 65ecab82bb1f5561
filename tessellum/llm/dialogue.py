"""Repair of conversations by error-correcting Earley parsing over a weighted grammar of roles.

The grammar says which order of roles' initials is right. Error productions let a row go (delete), stand under another
role (rerole) or be missing (insert), each at a cost. A column of the chart, one a row, holds for each item the least
(cost, audit) of all ways to it, the audit being the edits' initials so far; the completed start symbol of the last
column has the repair. Nonterminals stand only first in a rule, so every item begins at the first row, a column has a
handful of items whatever the length, and the columns before the last are not needed.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator
from functools import partial
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessellum.llm.common import FEW_KEYS, SPACE_CHARS, checkpointed

# The grammar of (s?(ua)+)?, the roles' names, the costs of edits, ends of sentences.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("talk", ()),
    ("talk", ("turns",)),
    ("turns", ("asked", "a")),
    ("asked", ("opening", "u")),
    ("asked", ("turns", "u")),
    ("opening", ()),
    ("opening", ("s",)),
)
START = "talk"
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
ENDS = (".", "!", "?")

#: Two inserts and a delete bring any parse to where another one is, so items that cost more than the best and this never win.
SLACK = 2 * INSERT + DELETE
#: Edits that all live items share are set aside when an audit is this long.
LONG = 4096

Item = tuple[int, int]


class Way(NamedTuple):
    """The least way to an item: its cost, its audit, and the digest of what it keeps, of which `added` is still to be taken in."""

    cost: int
    audit: str
    kept: Any
    added: tuple[tuple[str, str], ...]


class Chart:
    """The live column of one conversation's parse."""

    def __init__(self) -> None:
        empty = Way(0, "", None, ())
        self.done: list[str] = []
        self.column: dict[Item, Way] = {(k, 0): empty for k, (_, right) in enumerate(RULES) if not right or right[0] not in _WAITING}
        self._close()

    def _offer(self, column: dict[Item, Way], item: Item, way: Way) -> bool:
        old = column.get(item)
        if old is not None and (old.cost, old.audit) <= (way.cost, way.audit):
            return False
        column[item] = way
        return True

    def _close(self) -> None:
        """Completions and inserts, until nothing gets less; then each way's digest takes in what the way has added."""
        column, todo = self.column, list(self.column)
        while todo:
            item = todo.pop()
            cost, audit, kept, added = way = column[item]
            symbol = _AFTER[item]
            if symbol is None:
                for waiting in _WAITING[RULES[item[0]][0]]:
                    if self._offer(column, waiting, way):
                        todo.append(waiting)
            elif symbol in ROLES:
                moved = (item[0], item[1] + 1)
                if self._offer(column, moved, Way(cost + INSERT, audit + "I", kept, (*added, (ROLES[symbol], "")))):
                    todo.append(moved)
        most = min(way.cost for way in column.values()) + SLACK
        self.column = {item: _settled(way) for item, way in column.items() if way.cost <= most}

    def row(self, role: str, text: str, must_go: bool, cut: bool) -> None:
        """The next column: the row is deleted before any symbol that is waited for or after the whole, or it is such a symbol."""
        after: dict[Item, Way] = {}
        for item, (cost, audit, kept, added) in self.column.items():
            symbol = _AFTER[item]
            if symbol is None and RULES[item[0]][0] != START:
                continue
            self._offer(after, item, Way(cost + DELETE, audit + "D", kept, added))
            if symbol is None or must_go:
                continue
            moved, dear = (item[0], item[1] + 1), cost + CUT * cut
            if role[:1] == symbol:
                self._offer(after, moved, Way(dear, audit + "K", kept, (*added, (role, text))))
            elif symbol in ROLES:
                self._offer(after, moved, Way(dear + REROLE, audit + "R", kept, (*added, (ROLES[symbol], text))))
        self.column = after
        self._close()
        some = next(iter(self.column.values())).audit
        if len(some) >= LONG and (shared := len(os.path.commonprefix([way.audit for way in self.column.values()]))):
            self.done.append(some[:shared])
            self.column = {item: way._replace(audit=way.audit[shared:]) for item, way in self.column.items()}

    def repair(self) -> Way:
        best = min((way for item, way in self.column.items() if _AFTER[item] is None and RULES[item[0]][0] == START), key=lambda way: (way.cost, way.audit))
        return best._replace(audit="".join(self.done) + best.audit)


_AFTER: dict[Item, str | None] = {(k, dot): (right[dot] if dot < len(right) else None) for k, (_, right) in enumerate(RULES) for dot in range(len(right) + 1)}
_WAITING: dict[str, list[Item]] = {left: [(k, 1) for k, (_, right) in enumerate(RULES) if right[:1] == (left,)] for left, _ in RULES}


def _settled(way: Way) -> Way:
    if not way.added:
        return way
    new = "\n".join(f"{role}:{text}" for role, text in way.added).encode("utf-8", "surrogatepass")
    if way.kept is None:
        kept = hashlib.sha256(new)
    else:
        kept = way.kept.copy()
        kept.update(b"\n" + new)
    return way._replace(kept=kept, added=())


class _Conversation:
    """Counts and chart of the conversation that is being read, in the order of its turns."""

    def __init__(self, conv_id: Any) -> None:
        self.conv_id, self.chart = conv_id, Chart()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least: int | None = None
        self.last_turn: int | None = None
        self.before: str | None = None
        self.same: tuple[Any, ...] | None = None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.last_turn = turn
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        shown = text.rstrip(SPACE_CHARS)
        blank = not shown
        duplicate = not blank and (again or self.same == (turn, role, text))
        self.same = (turn, role, text)
        cut = not blank and not duplicate and not shown.endswith(ENDS)
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += cut
        self.chart.row(role, text, blank or duplicate, cut)

    def found(self) -> tuple[Any, ...]:
        best = self.chart.repair()
        gaps = 0 if self.least is None or self.last_turn is None else min(self.last_turn - self.least + 1 - self.turns, 2**63 - 1)
        digest = (best.kept or hashlib.sha256()).hexdigest()
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.cost, best.audit, digest


FOUND = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, ...]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            yield from zip(*(column.to_pylist() for column in batch.slice(at, 1000).columns), strict=True)


def _parsed(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, role, text, copies, again, dropped), those of a conversation together and in order."""
    types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    out: list[tuple[Any, ...]] = []

    def flushed() -> pa.RecordBatch:
        arrays = [pa.array(column, kind) for column, kind in zip(zip(*out, strict=True), types, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", *FOUND])

    now: _Conversation | None = None
    for conv_id, turn, role, text, copies, again, dropped in _rows(batches):
        if now is None or conv_id != now.conv_id:
            if now is not None:
                out.append(now.found())
                if len(out) >= 5000:
                    yield flushed()
            now = _Conversation(conv_id)
        if not dropped:
            for _ in range(copies):
                now.add(turn, role, text, again)
    if now is not None:
        out.append(now.found())
        yield flushed()


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, and columns copies and dropped that say how often a row stands there.

    By crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 takes .!? out of it, 3 repeats it, 4 makes
    its role user. A null id or turn counts as one space in that; a null role or text is one space from here on.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(part("text"), "".join(ENDS), "")).otherwise(part("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(part("role"))
    faulty = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", fault.alias("fault"))
    return faulty.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"), (F.col("fault") == 0).alias("dropped"))


def _prepared(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, again, dropped), again: role and text stand in an earlier turn of the conversation.

    Only hashes are grouped, and only those that stand in two turns are joined back: to texts where they are, by a
    broadcast, as long as they are few.
    """
    known = {c.lower() for c in rows.columns}
    copies = F.col("copies").cast("int") if "copies" in known else F.lit(1)
    dropped = F.coalesce(F.col("dropped").cast("boolean"), F.lit(False)) if "dropped" in known else F.lit(False)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), copies.alias("copies"), dropped.alias("dropped"))
    rows = rows.withColumn("text", F.when(~F.col("dropped"), F.col("text"))).withColumn("place", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    hashed = [F.xxhash64(F.lit(k), F.col("conv_id").isNull(), "conv_id", "role", "text").alias(f"k{k}") for k in (1, 2)]
    rows = rows.select("*", *hashed)
    first = rows.where(~F.col("dropped")).groupBy("k1", "k2").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").drop("last")
    first = checkpointed(first)
    few = first.count()
    if few:
        rows = rows.join(F.broadcast(first) if few <= FEW_KEYS // 4 else first, ["k1", "k2"], "left").withColumn("again", F.coalesce(F.col("place") > F.col("first"), F.lit(False)))
    else:
        rows = rows.withColumn("again", F.lit(False))
    return rows.select("conv_id", "turn", "role", "text", "copies", "again", "dropped")


def _in_order(rows: DataFrame, *before: Column) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *before, F.col("turn").asc_nulls_first(), "role", "text")


def repairs(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conversation.

    rows: (conv_id, turn, role, text), and if they are there copies (the row stands there so often, all adjacent) and
    dropped (it doesn't, but its conversation is named). Other columns don't matter. gaps: missing turns between the least
    and the last. blank, duplicate, truncated: rows by their first fault, that is no character but ASCII white space; role
    and text of an earlier row; no .!? at its end. illegal: neighbours whose roles' initials are not su, ua or au. cost and
    audit: the cheapest edits, the ASCII-least of equally cheap ones. repaired_sha256: of the repaired rows as `role:text`,
    joined by newlines.

    Rows are taken by turn, null turns first; of one turn by role and text, so ties are settled by what they say, and equal
    rows are adjacent. A null role or text is one space; a null conv_id is a conversation. A role without an initial fits
    nowhere. Conversations that have only dropped rows have zeros, an empty audit and the hash of nothing; an empty table
    gives an empty one. A conversation is read once, in order, sorted by Spark with spills: a task holds one batch of rows,
    the live column and the audit, one byte a row, but neither the conversation's texts nor its rows. Its hash is serial, so
    one conversation is one task's; work grows with its rows.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    kinds = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in FOUND)
    arrow = _arrow_type(rows)
    return _in_order(_prepared(rows)).mapInArrow(partial(_parsed, id_type=arrow), f"conv_id {id_type}, {kinds}")


def _arrow_type(rows: DataFrame) -> pa.DataType:
    return to_arrow_type(rows.schema["conv_id"].dataType)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the rows of each repaired conversation, from 0; edit is K, R or I.

    rows and their order as in repairs(), whose audits are read beside them: a task holds one audit and one batch.
    """
    arrow = _arrow_type(rows)
    empty = lambda kind, name: F.lit(None).cast(kind).alias(name)
    audits = repairs(rows).select("conv_id", empty("long", "turn"), empty("string", "role"), F.col("audit").alias("text"), F.lit(1).alias("copies"), F.lit(True).alias("audit"))
    both = _prepared(rows).where(~F.col("dropped")).select("conv_id", "turn", "role", "text", "copies", F.lit(False).alias("audit")).unionByName(audits)

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[Any, ...]] = []
        audit, at, made, symbol = "", 0, 0, "u"

        def emit(conv_id: Any, edit: str, role: str, text: str) -> None:
            nonlocal made, symbol
            out.append((conv_id, made, edit, role, text))
            made += 1
            symbol = "a" if role[:1] == "u" else "u"

        def inserts(conv_id: Any) -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                emit(conv_id, "I", ROLES[symbol], "")
                at += 1

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 5
            out.clear()
            types = [arrow, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "position", "edit", "role", "text"])

        for conv_id, _, role, text, copies, is_audit in _rows(batches):
            if is_audit:
                audit, at, made, symbol = text, 0, 0, "u"
                inserts(conv_id)
                continue
            for _ in range(copies):
                edit = audit[at]
                at += 1
                if edit != "D":
                    emit(conv_id, edit, role if edit == "K" else ROLES[symbol], text)
                inserts(conv_id)
            if len(out) >= 1000:
                yield flushed()
        yield flushed()

    id_type = rows.schema["conv_id"].dataType.simpleString()
    return _in_order(both, F.col("audit").desc()).mapInArrow(edited, f"conv_id {id_type}, position long, edit string, role string, text string")
