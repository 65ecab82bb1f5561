"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule reads measures of a text. On a sample each rule's time is its cost, and the order is made rule by rule: next
comes the one that rejects most per cost of the rows that those before it leave.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import SPACE_CHARS, ascii_words, checkpointed, let

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def word_chars(text: Column) -> Column:
    """Code points that stand in words."""
    return F.length(F.translate(text, SPACE_CHARS, ""))


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return F.when(F.contains(text, F.lit("\n")), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0)


def n_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))


def n_repeat_words(words: Column) -> Column:
    """Words that stand in a window of eight words found twice or more in the text, its first place included.

    Windows are compared by a 64-bit hash of their words' hashes. Only a text that repeats a window is sorted.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def places(found: Column) -> Column:
        by_hash = F.array_sort(F.transform(found, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            like = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.filter(s, lambda x, k: like(x, k - 1) | like(x, k + 1))

        return F.array_sort(F.transform(let(by_hash, repeated), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(let(places(found), covered))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, 0).otherwise(let(let(hashes, windows), count))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def n_capitals(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Z]"))


#: Measures by name, each of a text that is not null.
MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": lambda t: let(ascii_words(t), n_repeat_words),
    "n_lines": n_lines,
    "n_capitals": n_capitals,
}


def features(text: Column) -> Column:
    """struct of all measures, long; null text counts as empty. What measures share is computed once."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(ascii_words(text), lambda w: F.struct(F.size(w).alias("n"), n_repeat_words(w).alias("r")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.when(F.size(x) < 2, 0).otherwise(F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    long = lambda **columns: F.struct(*[c.cast("long").alias(k) for k, c in columns.items()])
    return let(
        F.struct(counted.alias("w"), by_line.alias("l")),
        lambda c: long(
            n_words=c["w"]["n"], word_chars=word_chars(text), n_symbols=n_symbols(text), n_dup_lines=c["l"]["d"], n_repeat_words=c["w"]["r"], n_lines=c["l"]["n"], n_capitals=n_capitals(text)
        ),
    )


class Measures:
    """A text's measures by name: those that are known already as columns, others computed from the text."""

    def __init__(self, text: Column, known: Mapping[str, Column] | None = None) -> None:
        self.text, self.known = text, known or {}

    def __getitem__(self, name: str) -> Column:
        return self.known[name] if name in self.known else MEASURES[name](self.text)


@dataclass(frozen=True)
class Rule:
    """rejects(measures) is true for a text that the rule turns down. rejection: its rate among the rows that the rules before it leave."""

    name: str
    rejects: Callable[[Measures], Column]
    rejection: float = 0.0
    cost: float = 1.0


BASE_RULES = (
    Rule("few_words", lambda m: m["n_words"] < 20),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
)
#: Thresholds that ordinary prose is far from.
METHOD_RULES = (
    Rule("symbols", lambda m: 4 * m["n_symbols"] > m["n_words"]),
    Rule("word_length", lambda m: let(m["n_words"], lambda n: (m["word_chars"] < 2 * n) | (m["word_chars"] > 14 * n))),
    Rule("shouting", lambda m: 2 * m["n_capitals"] > m["word_chars"]),
    Rule("repeated_lines", lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
)


def _repeats_lines(m: Measures) -> Column:
    """Of the lines with a word, more than three tenths equal an earlier one, and so do more than three tenths of their characters."""
    chars = lambda lines: F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))
    repeats = lambda x: let(F.array_distinct(x), lambda y: (10 * (F.size(x) - F.size(y)) > 3 * F.size(x)) & (10 * (chars(x) - chars(y)) > 3 * chars(x)))
    lines = F.filter(F.split(m.text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return F.when(F.contains(m.text, F.lit("\n")), let(lines, repeats)).otherwise(False)


#: The pipeline's: repeated lines count by their characters as well, so that one short line that stands twice in a text of three
#: is no reason to drop it. op8_quality keeps the rule by number of lines, which its SQL states.
PIPELINE_RULES = BASE_RULES + tuple(replace(r, rejects=_repeats_lines) if r.name == "repeated_lines" else r for r in METHOD_RULES)


def order_rules(rules: Sequence[Rule], rows: Mapping[tuple[bool, ...], int]) -> list[Rule]:
    """The rules with their costs, in the order of a cascade; rows: how many rows each combination of their verdicts has.

    Greedy: of the rules left, the next is the one with most rejections per cost among the rows that none before it rejects;
    ties, such as of rules that reject nothing more, go to the cheaper one, then to the order given.
    """
    left, order = dict(rows), []
    while len(order) < len(rules):
        total = sum(left.values())
        rate = lambda k: sum(n for verdicts, n in left.items() if verdicts[k]) / total if total else 0.0  # noqa: B023, E731
        best = min((k for k in range(len(rules)) if k not in {o for o, _ in order}), key=lambda k: (-rate(k) / rules[k].cost, rules[k].cost, k))
        order.append((best, rate(best)))
        left = {verdicts: n for verdicts, n in left.items() if not verdicts[best]}
    return [replace(rules[k], rejection=r) for k, r in order]


def plan_cascade(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = BASE_RULES + METHOD_RULES, *, known: Sequence[str] = (), sample_rows: int = 1000) -> list[Rule]:
    """The rules, with the rejection rate and cost on a sample, in the order of a cascade.

    The sample has about sample_rows rows, picked by a hash of the row; it is written once, and each rule's cost
    is its time there, beyond that of a pass without a rule. Measures named in known are columns of docs and cost nothing
    more. The order changes what a cascade costs, never its verdict. An empty table leaves the order as it is.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    total = docs.count()
    keep = F.pmod(F.xxhash64(text, F.lit("sample")), F.lit(max(1, total // max(1, sample_rows)))) == 0
    sample = checkpointed(docs.where(keep).select(text.alias("text"), *known))
    measures = Measures(F.col("text"), {k: F.col(k) for k in known})

    def timed(condition: Column) -> float:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            sample.agg(F.count_if(condition)).first()
            took.append(time.perf_counter() - began)
        return min(took)

    verdicts = [F.coalesce(r.rejects(measures), F.lit(False)).alias(f"r{k}") for k, r in enumerate(rules)]
    rows = {tuple(r[:-1]): r[-1] for r in sample.select(*verdicts).groupBy(*[f"r{k}" for k in range(len(rules))]).count().collect()}
    if not rows:
        return list(rules)
    empty = timed(F.length("text") < 0)
    return order_rules([replace(r, cost=max(timed(r.rejects(measures)) - empty, 1e-4)) for r in rules], rows)


def first_rejection(text: Column, rules: Sequence[Rule], known: Mapping[str, Column] | None = None) -> Column:
    """The name of the first rule, in the order given, that rejects the text; null if none does. Later rules are not computed."""
    measures = Measures(F.coalesce(text.cast("string"), F.lit("")), known)
    chain = F.lit(None).cast("string")
    for rule in reversed(rules):
        chain = F.when(rule.rejects(measures), F.lit(rule.name)).otherwise(chain)
    return chain


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample_rows: int = 1000) -> DataFrame:
    """(doc_id, five measures, base_failed, kept), a row for each row of docs.

    All measures are asked for, so they are computed once, and the cascade of base and method rules reads them. Null text
    counts as empty, and so fails for its number of words; very long texts are taken whole. Repeated rows each get their
    row, an empty table gives an empty one, columns other than the two named don't matter.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = picked.select("doc_id", "text", features(F.col("text")).alias("f"))
    order = plan_cascade(found.select("text", "f.*"), "text", BASE_RULES + METHOD_RULES, known=list(MEASURES), sample_rows=sample_rows)
    known = {k: F.col(f"f.{k}") for k in MEASURES}
    failed = F.lit(False)
    for rule in BASE_RULES:
        failed = failed | rule.rejects(Measures(F.col("text"), known))
    kept = first_rejection(F.lit(""), order, known).isNull()
    return found.select("doc_id", *[f"f.{k}" for k in list(MEASURES)[:5]], failed.alias("base_failed"), kept.alias("kept"))


def quality_filter(docs: DataFrame, text_col: str = "text", *, rules: Sequence[Rule] = BASE_RULES + METHOD_RULES, sample_rows: int = 1000) -> DataFrame:
    """The rows of docs, all columns, whose text no rule rejects; a rule's measures are computed where the cascade comes to it.

    Null text counts as empty, very long texts are taken whole. Repeated rows each stay or go, an empty table gives an empty
    one, columns may have any name.
    """
    order = plan_cascade(docs.select(F.col(f"`{text_col}`").alias("text")), "text", rules, sample_rows=sample_rows)
    return docs.where(first_rejection(F.col(f"`{text_col}`"), order).isNull())


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, t, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cover USING (doc_id)
), g AS (
  SELECT *, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 4 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR 2 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > word_chars OR 10 * n_dup_lines > 3 * len(ls)) AS kept
FROM g
"""
