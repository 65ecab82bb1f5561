"""URL filter: rules on host and path, and logistic regression on hashed character n-grams for what no rule covers.

The labelled table is small: URLs with a known verdict, by default those of labelled_urls.csv beside this file, of
invented hosts. At most ROWS different ones train the model, in numpy on the driver; it is one vector of SLOTS weights
that each worker applies to its rows, a batch at once.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host and path), fixed values: the rules of the query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Training bound, a documented parameter: labelled URLs, picked by a hash of host and path.
ROWS = 4000
SLOTS = 1 << 16
GRAMS = (3, 4, 5)
STEPS = 300
_STEP = np.uint64(0x9E3779B97F4A7C15)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ://."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def labelled_urls() -> list[tuple[str, str, bool]]:
    """(host, path, to block) of the table beside this file."""
    with Path(__file__).with_name("labelled_urls.csv").open(newline="") as file:
        return [(*_parted(row["url"]), row["verdict"] == "block") for row in csv.DictReader(file)]


def _parted(url: str) -> tuple[str, str]:
    host, slash, path = url.partition("/")
    return host, slash + path


def slots(hosts: Sequence[str], paths: Sequence[str], n: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot), sorted, of the different slots of each row's n-grams of host and path, each with its ends marked; host and path don't share n-grams."""
    found = [np.zeros(0, np.int64)]
    for mark, texts in ((1, hosts), (2, paths)):
        raw = [f"^{t}$".encode("utf-8", "surrogatepass") for t in texts]
        code = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        for k in GRAMS:
            m = max(0, len(code) - k + 1)
            h = np.full(m, mark * 16 + k, np.uint64)
            for j in range(k):
                h = (h ^ code[j : j + m]) * _STEP
                h ^= h >> np.uint64(29)
            whole = owner[:m] == owner[len(owner) - m :]
            found.append((owner[:m] * n + (h % np.uint64(n)).astype(np.int64))[whole])
    both = np.unique(np.concatenate(found))
    return both // n, both % n


class Model:
    """Weights by slot, and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """Probability that each URL is one to block."""
        row, col = slots(hosts, paths, len(self.weights))
        size = np.maximum(1, np.bincount(row, minlength=len(hosts)))
        return 1 / (1 + np.exp(-(self.bias + np.bincount(row, weights=self.weights[col], minlength=len(hosts)) / np.sqrt(size))))

    @classmethod
    def fit(cls, rows: Sequence[tuple[str, str, bool]], n: int = SLOTS, steps: int = STEPS, l2: float = 1e-4) -> Model:
        """Gradient descent on (host, path, to block); no rows: bias zero, which blocks nothing."""
        if not rows:
            return cls(np.zeros(n), 0.0)
        row, col = slots([h for h, *_ in rows], [p for _, p, _ in rows], n)
        value = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(rows))))[row]
        y = np.array([b for *_, b in rows], float)
        share = (y.sum() + 1) / (len(y) + 2)
        w, bias = np.zeros(n), float(np.log(share / (1 - share)))
        speed = np.zeros(n)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(bias + np.bincount(row, weights=value * w[col], minlength=len(rows)))))
            slope = np.bincount(col, weights=value * (p - y)[row], minlength=n) / len(rows) + l2 * w
            speed = 0.9 * speed - 2.0 * slope
            w, bias = w + speed, bias - float((p - y).mean())
        return cls(w, bias)


def train(labelled: DataFrame, rows: int = ROWS) -> Model:
    """From (host, path, verdict): at most `rows` different ones, the first by a hash of host and path. Rows with a null don't count."""
    once = labelled.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    few = once.orderBy(F.xxhash64("host", "path"), "host", "path").limit(rows).collect()
    return Model.fit([(r["host"], r["path"], r["verdict"] == "block") for r in few])


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None, rows: int = ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), a row for each row of pages.

    verdict: the longest fitting rule's, of two equal ones the last; else the model's: block if score is above one half.
    score: the model's, for every row. labelled: (host, path, verdict) to learn from, by default labelled_urls(). A null
    URL has empty host and path and is judged by the model; very long ones are taken whole. Repeated rows and null ids keep
    their rows; an empty table gives an empty one; columns other than the two named are not read.
    """
    host, path = host_and_path(F.col(url_col))
    each = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    each = each.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    known = pages.sparkSession.sparkContext.broadcast(Model.fit(labelled_urls()) if labelled is None else train(labelled, rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = known.value.scores(batch["host"].tolist(), batch["path"].tolist())
            batch["verdict"] = batch["verdict"].where(batch["verdict"].notna(), np.where(score > 0.5, "block", "allow"))
            yield batch.assign(score=score)

    kind = each.schema["page_id"].dataType.simpleString()
    return each.mapInPandas(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
