"""Log-bilinear language model trained by noise-contrastive estimation, over counts of the whole training corpus.

Tokens are the words of a text, lower-cased, and one end. The most frequent words are classes of their own, more of
them the more tokens there are (top_classes); all others share BUCKETS classes by a hash, and within a bucket a word
has its smoothed share of the bucket's tokens. The model predicts a token's class from the class at each of the
SHARES positions before it, score_k(v | u) = (r_u C_k) . r_v + b_v, and mixes the positions' normalised probabilities.
Noise-contrastive estimation needs of the corpus only how often each pair of classes stands at each distance, so
Spark counts pairs over every training text and the numpy training sees all of them. Products of whole batches of
contexts with all classes, normalised, give the log-probabilities; as each is of one class, all of them fit tables.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.llm.common import checkpointed

#: Classes of their own: TOP_SCALE times the TOP_ROOT-th root of the training tokens.
TOP_SCALE, TOP_ROOT = 120, 8
BUCKETS = 63
#: Weights of the positions before a token, the nearest first.
SHARES = (0.6, 0.4)
#: Words, the most frequent ones, whose counts each worker holds; the counts of all other words are joined.
HOT = 1 << 18
DIMENSIONS = 24
NOISE = 16
STEPS = 150
#: Bytes of text worked on at once, about.
CHUNK = 1 << 22
#: Different words that a task counts before it hands them on.
FLUSH = 400_000


def top_classes(total: int) -> int:
    """Words that are classes of their own, for a number of training tokens: 954 for 16 million, 2,263 for 16 billion."""
    return round(TOP_SCALE * total ** (1 / TOP_ROOT))


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Runs of rows of about CHUNK bytes of text, and their words."""
    for batch in batches:
        first, size, words = 0, 0, []
        for i, text in enumerate(batch[column]):
            text = text.as_py()
            words.append(tokens(text))
            size += len(text or "")
            if size >= CHUNK:
                yield batch.slice(first, i + 1 - first), words
                first, size, words = i + 1, 0, []
        if words:
            yield batch.slice(first), words


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all rows of texts, counted within each task and then by a shuffle of the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counter), pa.binary()).cast(pa.string()), pa.array(list(counter.values()), pa.int64())], ["word", "n"])
            counter.clear()
            return made

        for _, rows in _chunks(batches, text_col):
            for words in rows:
                counter.update(words)
            if len(counter) > FLUSH:
                yield out()
        yield out()

    return texts.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Of the training corpus: tokens, types, and of each hot word the count, class, and share of its class; log10 of class pairs at each position."""

    total: int
    types: int
    ends: int
    hot: dict[bytes, int]
    counts: np.ndarray
    classes: np.ndarray
    within: np.ndarray
    top: int
    bucket_tokens: np.ndarray
    pairs: np.ndarray

    @property
    def denominator(self) -> float:
        return self.total + 0.5 * (self.types + 1)

    def encode(self, rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(hot index of each token, -1 for other words and ends; class of each token; start of each row; the words)."""
        sizes = np.array([len(r) + 1 for r in rows], np.int64)
        ends = np.cumsum(sizes) - 1
        flat: list[bytes] = []
        for r in rows:
            flat.extend(r)
            flat.append(b"")
        index = np.fromiter(map(self.hot.get, flat, repeat(-1)), np.int32, len(flat))
        cls = np.zeros(len(flat), np.int32)
        known = index >= 0
        cls[known] = self.classes[index[known]]
        rare = ~known
        rare[ends] = False
        at = np.flatnonzero(rare)
        cls[at] = [self.top + 1 + zlib.crc32(flat[i]) % BUCKETS for i in at.tolist()]
        return index, cls, ends + 1 - sizes, flat


def before(cls: np.ndarray, starts: np.ndarray, position: int) -> np.ndarray:
    """The class `position` tokens before each token of its row; the end, 0, before the row's first."""
    out = np.zeros_like(cls)
    out[position:] = cls[: len(cls) - position]
    for at in range(position):
        first = starts + at
        sizes = np.append(starts[1:], len(cls)) - starts
        out[first[sizes > at]] = 0
    return out


def fit(pairs: np.ndarray, dimensions: int = DIMENSIONS, noise: int = NOISE, steps: int = STEPS, seed: int = 7) -> np.ndarray:
    """log10 probabilities [position, context, class] of the log-bilinear model that noise-contrastive estimation fits to pair counts.

    The expectation over the noise is taken exactly: each context's pairs, against `noise` draws a pair from the
    unigram distribution. Positions share the vectors r and biases b and have a matrix each. Full-batch Adam; deterministic.
    """
    positions, v = pairs.shape[:2]
    total = max(1.0, float(pairs[0].sum(dtype=np.float64)))
    unigram = ((pairs[0].sum(0, dtype=np.float64) + 0.5) / (total + 0.5 * v)).astype(np.float32)
    log_noise = np.log(noise * unigram)
    data = (pairs / np.float32(total)).astype(np.float32)
    contexts = data.sum(2)
    random = np.random.default_rng(seed)
    r = random.normal(0, 0.1, (v, dimensions)).astype(np.float32)
    c = np.stack([np.eye(dimensions, dtype=np.float32)] * positions)
    b = np.log(unigram)
    values = [r, c, b]
    first, second = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]
    for step in range(1, steps + 1):
        slopes = [-1e-7 * r, np.zeros_like(c), np.zeros_like(b)]
        for k in range(positions):
            q = r @ c[k]
            p = q @ r.T
            p += b - log_noise
            np.clip(p, -30, 30, out=p)
            np.exp(-p, out=p)
            p += 1
            np.reciprocal(p, out=p)
            g = data[k] * (1 - p)
            p *= contexts[k][:, None]
            p *= noise * unigram
            g -= p
            gr = g @ r
            slopes[0] += gr @ c[k].T + g.T @ q
            slopes[1][k] = r.T @ gr
            slopes[2] += g.sum(0)
        rate = 0.05 * (1 - step / (steps + 1))
        for x, s, m, n in zip(values, slopes, first, second, strict=True):
            m += 0.1 * (s - m)
            n += 0.01 * (s * s - n)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(n / (1 - 0.99**step)) + 1e-9)
    out = np.empty((positions, v, v), np.float32)
    for k in range(positions):
        for at in range(0, v, 256):
            score = (r[at : at + 256] @ c[k]) @ r.T + b
            score -= score.max(1, keepdims=True)
            out[k, at : at + 256] = (score - np.log(np.exp(score).sum(1, keepdims=True))) / np.log(10)
    return out


def class_pairs(texts: DataFrame, text_col: str, model: Model, positions: int = len(SHARES)) -> np.ndarray:
    """[position, context, class]: how often each class follows each other at each distance, a text's end before its first word, over all rows of texts.

    A task holds one count for each cell, 8 * positions * classes^2 bytes: 24 MB at 80 million tokens.
    """
    v = model.top + 1 + BUCKETS
    known = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(positions * v * v, np.int64)
        for _, rows in _chunks(batches, text_col):
            _, cls, starts, _ = known.value.encode(rows)
            for k in range(positions):
                pair, n = np.unique((k * v + before(cls, starts, k + 1).astype(np.int64)) * v + cls, return_counts=True)
                seen[pair] += n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["pair", "n"])

    found = texts.select(text_col).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(positions * v * v, np.float32)
    for part in found.to_batches():
        out[part["pair"].to_numpy()] = part["n"].to_numpy()
    return out.reshape(positions, v, v)


def train(texts: DataFrame, text_col: str = "text", *, top: int | None = None, hot: int = HOT, steps: int = STEPS) -> tuple[Model, DataFrame]:
    """(model, counts (word, n) of all training words), from every row of texts; null text is the empty one, of one end.

    The driver gets `hot` words at most, and at most (top + 1 + BUCKETS)^2 pair counts a position; top is
    top_classes of the training tokens unless it is given, so that a thousand times the tokens have 2.4 times the classes.
    """
    texts = texts.select(F.col(text_col).cast("string").alias(text_col))
    counts = checkpointed(word_counts(texts, text_col))
    ends = texts.count()
    words, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the hot words by a histogram of counts, so that no task ranks all words
    bars = counts.groupBy("n").agg(F.count("*").alias("words"))
    least = bars.withColumn("above", F.sum("words").over(Window.orderBy(F.desc("n")))).where(F.col("above") <= hot).agg(F.min("n")).first()[0]
    best = counts.where(F.col("n") >= (least if least is not None else 1 << 62)).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    top = min(top_classes(words + ends) if top is None else top, len(best))
    spelled = best["word"].cast(pa.binary()).to_pylist()
    n = best["n"].to_numpy()
    bucket = np.array([zlib.crc32(w) % BUCKETS for w in spelled], np.int64)
    per = {r["b"]: (r["n"], r["words"]) for r in counts.groupBy((F.crc32(F.col("word").cast("binary")) % BUCKETS).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    tokens_in = np.array([per.get(b, (0, 0))[0] for b in range(BUCKETS)], float) - np.bincount(bucket[:top], weights=n[:top], minlength=BUCKETS)
    types_in = np.array([per.get(b, (0, 0))[1] for b in range(BUCKETS)], float) - np.bincount(bucket[:top], minlength=BUCKETS)
    mass = tokens_in + 0.5 * (types_in + 1)
    classes = np.where(np.arange(len(n)) < top, np.arange(len(n)) + 1, top + 1 + bucket).astype(np.int32)
    within = np.where(np.arange(len(n)) < top, 0.0, np.log10((n + 0.5) / mass[bucket]))
    model = Model(words + ends, types + (ends > 0), ends, dict(zip(spelled, range(len(n)), strict=True)), n, classes, within, top, mass, np.zeros((0, 0, 0)))
    model.pairs = fit(class_pairs(texts, text_col, model), steps=steps)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, the columns of keep, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    Both scores are log10 of the whole text's probability: base_score by smoothed unigrams, score by the model. Null
    text counts as empty: one token, the end. Repeated rows and null ids each keep their row; an empty table gives an
    empty one; with no training text all words are unknown and all classes about alike. Only words beyond the hot
    ones leave their row: their counts are joined by word, once for each different text.
    """
    keep = keep or {}
    picked = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in keep.items()], F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(model)
    pass_on = [c for c in picked.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        base_hot = np.log10((m.counts + 0.5) / m.denominator)
        base_end = np.log10((m.ends + 0.5) / m.denominator)
        for part, rows in _chunks(batches, "text"):
            index, cls, starts, flat = m.encode(rows)
            hot = index >= 0
            last = np.append(starts[1:], len(flat)) - 1
            base, model_score = np.zeros(len(flat)), np.zeros(len(flat))
            base[hot] = base_hot[index[hot]]
            base[last] = base_end
            model_score[hot] = m.within[index[hot]]
            mixed = np.zeros(len(flat))
            for k, share in enumerate(SHARES):
                mixed += share * np.power(10.0, m.pairs[k, before(cls, starts, k + 1), cls])
            model_score += np.log10(mixed)
            known_n = hot.astype(np.int64)
            known_n[last] = int(m.ends > 0)
            rare = ~hot
            rare[last] = False
            at = np.flatnonzero(rare)
            cut = np.searchsorted(at, np.append(starts, len(flat)))
            words, times, offsets = [], [], [0]
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                found = Counter([flat[i] for i in at[a:b].tolist()])
                words.extend(found)
                times.extend(found.values())
                offsets.append(len(words))
            offsets = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(words, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))]
            sums = [np.add.reduceat(known_n, starts), np.add.reduceat(base, starts), np.add.reduceat(model_score, starts)]
            arrays = [part[c] for c in pass_on] + [pa.array(last + 1 - starts, pa.int64()), *map(pa.array, sums), *lists]
            yield pa.RecordBatch.from_arrays(arrays, [*pass_on, "n_tokens", "known", "base", "model", "words", "times"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.drop("text").schema.fields)
    rows = checkpointed(picked.mapInArrow(run, f"{kinds}, n_tokens long, known long, base double, model double, words array<string>, times array<int>"))
    once = rows.where(F.size("words") > 0).groupBy("text_key").agg(F.first(F.arrays_zip("words", "times")).alias("rare"))
    each = once.select("text_key", F.explode("rare").alias("w")).select("text_key", F.col("w.words").alias("w"), F.col("w.times").alias("times"))
    joined = each.join(counts, each["w"] == counts["word"], "left").withColumn("c", F.coalesce("n", F.lit(0)))
    mass = F.element_at(F.array(*[F.lit(float(x)) for x in model.bucket_tokens]), (F.crc32(F.col("w").cast("binary")) % BUCKETS + 1).cast("int"))
    rare = joined.groupBy("text_key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / F.lit(float(model.denominator)))).alias("rare_base"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / mass)).alias("rare_model"),
    )
    rare = rare.withColumnRenamed("text_key", "k")
    out = rows.drop("words", "times").join(rare, F.col("text_key") == F.col("k"), "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select("doc_id", *keep, "n_tokens", plus("known", "rare_known").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), plus("base", "rare_base").alias("base_score"), plus("model", "rare_model").alias("score"))
