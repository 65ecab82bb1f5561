"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has one row of numbers a slot, and one bit of it a language. The AND of an n-gram's slots gives
all languages whose training text holds it. A text's votes for a language are its n-grams with that bit, less those
that the filter's share of set slots makes up by chance; the most votes decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.llm.common import HEAVY, checkpointed

N = 4
SLOTS = 1 << 20
PROBES = 3
#: Training bounds, documented parameters: labelled rows a language, about; n-grams kept a language.
ROWS = 3000
GRAMS = 30_000
#: A language has an n-gram if it is this often there, against the language where it is most often.
SHARE = 0.2
#: Characters worked on at once.
CHUNK = 1 << 21

_LETTER = np.zeros(0x110000, bool)
_LETTER[[c for c in range(0x30000) if chr(c).isalpha()]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, index of the text) of all n-grams that hold two letters or more; other characters than letters are one blank."""
    blank = " " * N
    joined = blank + blank.join(t.lower() for t in texts) + blank
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[codes]
    codes = np.where(letter, codes, 0).astype(np.uint64)
    sizes = np.array([len(t.lower()) + N for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    n = len(owner)
    h = np.zeros(n, np.uint64)
    letters = np.zeros(n, np.int8)
    for k in range(N):
        h = (h ^ codes[k + 1 : n + k + 1]) * _STEP
        h ^= h >> np.uint64(29)
        letters += letter[k + 1 : n + k + 1]
    keep = letters >= 2
    return h[keep], owner[keep]


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of CHUNK characters, about, and the index of their first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


@dataclass
class Filter:
    """languages: their names, by bit; slots: the bit masks, 64 languages a row; fallback: the language of texts without a vote."""

    languages: list[str]
    slots: np.ndarray
    fallback: str

    def _at(self, h: np.ndarray, probe: int) -> np.ndarray:
        mixed = h * np.uint64(2 * probe + 0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(40)).astype(np.int64) % self.slots.shape[1]

    @classmethod
    def of(cls, sets: dict[str, np.ndarray], fallback: str, slots: int = SLOTS) -> Filter:
        made = cls(sorted(sets), np.zeros((max(1, -(-len(sets) // 64)), slots), np.uint64), fallback)
        for bit, language in enumerate(made.languages):
            for probe in range(PROBES):
                at = np.unique(made._at(sets[language], probe))
                made.slots[bit // 64, at] |= np.uint64(1 << bit % 64)
        return made

    def masks(self, h: np.ndarray) -> np.ndarray:
        """The languages that hold each n-gram, a bit each, 64 languages a row."""
        mask = self.slots[:, self._at(h, 0)]
        for probe in range(1, PROBES):
            mask = mask & self.slots[:, self._at(h, probe)]
        return mask

    def votes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected votes (text, language), and n-grams of each text."""
        bit = lambda words, b: (words[b // 64] >> np.uint64(b % 64)) & np.uint64(1)
        false = np.array([bit(self.slots, b).mean() for b in range(len(self.languages))]) ** PROBES
        hits, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for first, part in chunks(texts):
            h, owner = grams(part)
            mask = self.masks(h)
            n[first : first + len(part)] = np.bincount(owner, minlength=len(part))
            for b in range(len(self.languages)):
                hits[first : first + len(part), b] = np.bincount(owner, weights=bit(mask, b), minlength=len(part))
        return np.maximum(0, (hits - n[:, None] * false) / np.maximum(1e-9, 1 - false)), n

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        votes, n = self.votes(texts)
        out = []
        for t, v, k in zip(texts, votes, n, strict=True):
            if not any(map(str.isalpha, t)):
                out.append(("und", 0.0))
            elif not v.any():
                out.append((self.fallback, 0.0))
            else:
                best = int(v.argmax())
                out.append((self.languages[best], float(min(1.0, v[best] / k))))
        return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, rows: int = ROWS, grams_kept: int = GRAMS) -> Filter | None:
    """A filter of the languages of docs; rows with a null text or language don't count; None if there is no other.

    Bounds: about `rows` texts a language, picked by a hash of the text, whole; of each language about grams_kept n-grams,
    the most frequent, and of those that are equally frequent, where not all have room, the least by a hash. A language
    with fewer n-grams has all of them, those that occur once included. N-grams are counted in Spark; the driver gets
    about languages * grams_kept hashes and counts. A text in several languages' rows trains each. Very long texts are
    taken whole, repeated texts count once.
    """
    labelled = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()}
    if not sizes:
        return None
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, rows / n)).otherwise(share)
    # a text that many rows repeat is in or out as a whole: it counts once
    picked = labelled.where(F.pmod(F.xxhash64("text", F.lit("train")), F.lit(1 << 20)) < share * (1 << 20)).distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                for _, texts in chunks(part["text"].tolist()):
                    h, n = np.unique(grams(texts)[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": h.view(np.int64), "n": n})

    counted = picked.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = checkpointed(counted)
    total = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    # the kept_th count by a histogram, so that no window holds all n-grams of a language
    bars = counted.groupBy("lang", "n").agg(F.count("*").alias("grams"))
    bars = bars.withColumn("above", F.sum("grams").over(Window.partitionBy("lang").orderBy(F.desc("n"))))
    bars = bars.withColumn("room", grams_kept - F.col("above") + F.col("grams")).where("room > 0")
    bars = bars.select(F.col("lang").alias("l"), F.col("n").alias("m"), (F.col("room") / F.col("grams")).alias("share"))
    fits = (F.pmod(F.xxhash64("gram", F.lit("room")), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    kept = counted.join(F.broadcast(bars) if bars.count() <= HEAVY else bars, (F.col("lang") == F.col("l")) & (F.col("n") == F.col("m"))).where(fits).select("lang", "gram", "n").toPandas()
    kept["rate"] = kept["n"] / kept["lang"].map(total)
    kept = kept[kept["rate"] >= SHARE * kept.groupby("gram")["rate"].transform("max")]
    sets = {lang: part["gram"].to_numpy(np.int64).view(np.uint64) for lang, part in kept.groupby("lang")}
    return Filter.of({lang: sets.get(lang, np.zeros(0, np.uint64)) for lang in sizes}, next(iter(sizes)))


def identify(docs: DataFrame, model: Filter | None, id_col: str = "doc_id", text_col: str = "text", *, keep: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, the columns of keep, lang_pred, score), a row for each row of docs.

    score: the share of a text's n-grams that its language holds. `und` and 0 for a null text or one without a
    letter, and for all if there is no model; a text whose n-grams no language holds gets the most frequent language
    and 0. Votes that tie go to the first language by name. Very long texts are read whole, in runs. Repeated rows each get
    their row, an empty table gives an empty one, other columns are not read. The filter, SLOTS numbers for each 64
    languages, is sent to each worker once.
    """
    keep = keep or {}
    picked = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in keep.items()], F.col(text_col).cast("string").alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            found = known.value.predict(texts) if known.value else [("und", 0.0)] * len(texts)
            yield batch.drop(columns="text").assign(lang_pred=[x for x, _ in found], score=[s for _, s in found])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.drop("text").schema.fields)
    return picked.mapInPandas(run, f"{fields}, lang_pred string, score double")
