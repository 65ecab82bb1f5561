"""Secret scan with corpus-wide ownership frequency.

Base rules find assignments, access keys and long hex strings. The method adds candidates that those miss (kind
`entropy`, and well-known key prefixes as kind `prefix`), and judges all values by who has them: values are
hashed, and a hash is counted by distinct repositories and by distinct owners over the whole corpus. A value that
many owners have, or several owners in many repositories, is an example copied around; one that stays with one owner,
in however many repositories, or with few is live-looking. Added candidates become spans only where their value is
live-looking; base spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import checkpointed

#: Kinds in the order of a tie of starts.
KINDS = ("assign", "access", "hex", "prefix", "entropy")
BASE = KINDS[:3]
#: (kind, pattern, group of the value, its least length). The first three.
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
    ("prefix", re.compile(r"\b(?:ghp_|gho_|github_pat_|glpat-|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}", re.A), 0, 20),
    ("entropy", re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}"), 0, 20),
)
#: Bits a character that an `entropy` candidate needs.
ENTROPY = 3.5
#: A value of this many owners or more is an example, and so is one of two owners or more in this many repositories.
OWNERS, REPOSITORIES = 3, 20

#: Every candidate holds one of these, so other texts need no scan.
HINT = r"(?i)password|passwd|secret|token|api_?key|[A-Za-z0-9+/_=-]{20}"

FOUND = "array<struct<kind:string,start:int,end:int,value_start:int,value:string>>"


def _bits(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def candidates(text: str | None) -> list[tuple[str, int, int, int, str]]:
    """(kind, start, end, start of the value, its sha256) by start, then kind, in code points, ends exclusive. Each kind is leftmost and does not overlap itself."""
    out = []
    for kind, pattern, group, least in RULES if text else ():
        for m in pattern.finditer(text):
            value = m[group]
            if len(value) >= least and (kind != "entropy" or _bits(value) >= ENTROPY):
                out.append((kind, m.start(), m.end(), m.start(group), hashlib.sha256(value.encode()).hexdigest()))
    rank = KINDS.index
    taken = _joined(sorted((s, e) for k, s, e, *_ in out if k in BASE))
    starts = [s for s, _ in taken]

    def free(start: int, end: int) -> bool:
        k = bisect_left(starts, end) - 1
        return k < 0 or taken[k][1] <= start

    out = [x for x in out if x[0] in BASE or free(x[1], x[2])]
    return sorted(out, key=lambda x: (x[1], rank(x[0])))


def find_candidates(text: Column) -> Column:
    names = ("kind", "start", "end", "value_start", "value")

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[dict(zip(names, c, strict=True)) for c in candidates(t)] for t in batch], dtype=object)

    return run(text)


def ownership(found: DataFrame) -> DataFrame:
    """(value, repository, owner) -> (value, n_repositories, n_owners), by two rounds of map-side sums, so that a value that everyone has is no large group. Nulls are one repository, one owner."""
    pairs = found.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    return owners.groupBy("value").agg(F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"))


def live_looking(example_owners: int, example_repositories: int) -> Column:
    """Beside n_repositories and n_owners: the value is no example."""
    return (F.col("n_owners") < example_owners) & ((F.col("n_owners") < 2) | (F.col("n_repositories") < example_repositories))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", *, example_owners: int = OWNERS, example_repositories: int = REPOSITORIES
) -> DataFrame:
    """(doc_id, text_key, spans) for each row of docs; spans: array of struct(kind, start, end, value_start, value, n_repositories, n_owners, live).

    spans holds every base span, and the added ones whose value is live-looking, which `live` says of each value: fewer
    than example_owners owners have it, and not two or more in example_repositories repositories. Null text counts as
    empty and has none; very long texts are scanned whole. Rows are told apart by nothing but their text, so repeated rows
    and null ids each keep their row. Spans that start together go by kind. An empty table gives an empty one; only the
    columns named are read, whatever others are called. Only values, by hash, leave their document; those are shuffled,
    not texts. A value, or a text, of many rows meets its verdict by a join whose plain shuffles can be split.
    """
    hint = F.coalesce(F.col(text_col).cast("string").rlike(HINT), F.lit(False))

    def read(part: DataFrame, found: Column) -> DataFrame:
        return part.select(
            F.col(id_col).alias("doc_id"),
            F.col(repository_col).cast("string").alias("repository"),
            F.col(owner_col).cast("string").alias("owner"),
            F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("text_key"),
            found.alias("found"),
        )

    rows = read(docs.where(hint), find_candidates(F.col(text_col).cast("string"))).unionByName(read(docs.where(~hint), F.array().cast(FOUND)))
    rows = checkpointed(rows)
    each = rows.where(F.size("found") > 0).select("repository", "owner", "text_key", F.explode("found").alias("c"))
    counts = ownership(each.select("c.value", "owner", "repository")).repartition("value")
    of_text = each.select("text_key", "c").distinct()
    judged = of_text.join(counts, of_text["c.value"] == counts["value"]).select("text_key", "c", "n_repositories", "n_owners", live_looking(example_owners, example_repositories).alias("live"))
    judged = judged.where(F.col("c.kind").isin(*BASE) | F.col("live"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("c.kind"))
    span = F.struct(F.col("c.start").alias("start"), rank.alias("rank"), "c.kind", "c.end", "c.value_start", "c.value", "n_repositories", "n_owners", "live")
    spans = judged.groupBy("text_key").agg(F.array_sort(F.collect_list(span)).alias("spans")).withColumnRenamed("text_key", "k").repartition("k")
    none, some = rows.where(F.size("found") == 0), rows.where(F.size("found") > 0)
    some = some.join(spans, some["text_key"] == spans["k"], "left").select("doc_id", "text_key", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))
    return some.unionByName(none.select("doc_id", "text_key", F.array().cast(spans.schema["spans"].dataType).alias("spans")))


def digest(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example) of scan()'s rows."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    n = lambda f: F.size(F.filter("spans", f)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    return scanned.select(
        "doc_id",
        *[n(of_kind(k)).alias(f"n_{k}") for k in BASE],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        n(lambda s: s["live"]).alias("n_live"),
        n(lambda s: ~s["live"]).alias("n_example"),
    )


def redact(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", *, mask: str = "[SECRET]", example_owners: int = OWNERS, example_repositories: int = REPOSITORIES
) -> DataFrame:
    """docs, all its columns and rows, with each live-looking value in the text replaced by mask; examples stay.

    Values that overlap are cut as one. Null and empty texts stay as they are, very long ones are taken whole, repeated rows
    each keep their row, an empty table gives an empty one, and columns may have any name. Only texts that may hold a value
    are joined to their spans; the others are not shuffled.
    """
    scanned = scan(docs, id_col, text_col, id_col, owner_col, example_owners=example_owners, example_repositories=example_repositories)
    live = F.filter("spans", lambda s: s["live"])
    cuts = scanned.select("text_key", live.alias("live")).where(F.size("live") > 0)
    cuts = cuts.select("text_key", F.transform("live", lambda s: F.struct(s["value_start"].alias("a"), s["end"].alias("b"))).alias("cuts")).distinct().repartition("text_key")
    found = docs.where(F.coalesce(F.col(text_col).cast("string").rlike(HINT), F.lit(False)))
    text = F.col(f"d.`{text_col}`")
    key = F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)
    joined = found.alias("d").join(cuts.alias("c"), key == F.col("c.text_key"), "left")

    def merge(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        into = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        return F.when((F.size(done) > 0) & (s["a"] < F.try_element_at(done, F.lit(-1))["b"]), into).otherwise(F.concat(done, F.array(s)))

    def cut(rest: Column, s: Column) -> Column:
        return F.concat(F.substring(rest, F.lit(1), s["a"]), F.lit(mask), F.substring(rest, s["b"] + 1, F.length(rest)))

    apart = F.aggregate(F.array_sort("c.cuts"), F.array().cast("array<struct<a:int,b:int>>"), merge)
    cleaned = F.when(F.col("c.cuts").isNull(), text).otherwise(F.aggregate(F.reverse(apart), text, cut))
    joined = joined.select(*[(cleaned if c == text_col else F.col(f"d.`{c}`")).alias(c) for c in docs.columns])
    return joined.unionByName(docs.where(~F.coalesce(F.col(text_col).cast("string").rlike(HINT), F.lit(False))))
