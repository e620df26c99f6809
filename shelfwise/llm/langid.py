"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram is the
product of its letter vectors, the first permuted (rotated) twice and the second once. A text
is the sum of its trigram vectors, scaled to length one; a language prototype is the sum of
the vectors of its training texts. What all languages share is taken off: the mean prototype is
subtracted from every prototype. The prediction is the prototype with the largest cosine.

Training: each task sums vectors per language, the sums are added by Spark in two steps; a
bounded number of texts (``max_training``, in equal shares per language, by hash of the key; at
least one of every language) is used. The model is one
vector per language and goes to the driver; ``max_languages`` bounds it.

Letters are lower-cased; anything else becomes one blank. Whole texts count. Defined cases:
null text, or no letter: ``und`` with score 0; rows without a language teach nothing; without
any training text every row is ``und``; equal cosines go to the first language by name; input
columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import put

DIMENSIONS = 2048
MAX_TRAINING = 60_000
MAX_LANGUAGES = 10_000
UNKNOWN = "und"
SHARPNESS = 12.0
_BITS = 21
_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """For every code point the lower-case letter, or 0."""
    global _LETTERS
    if _LETTERS is None:
        found = np.zeros(0x110000, dtype=np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                found[cp] = ord(low) if len(low) == 1 else cp
        _LETTERS = found
    return _LETTERS


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes of a text and their counts; both empty without a letter."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    found = letters()[cps].astype(np.int64)
    keep = np.ones(len(found), dtype=bool)
    keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
    found = found[keep]
    if not found.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([[0], found, [0]]) if len(found) > 1 else np.array([0, found[0], 0])
    top = int(padded.max()) + 1
    if top <= 512:  # Latin letters: count in a table instead of sorting
        narrow = (padded[:-2] * top + padded[1:-1]) * top + padded[2:]
        if len(narrow) * 8 > top ** 3:
            counts = np.bincount(narrow)
            codes = np.flatnonzero(counts)
            counts = counts[codes]
        else:
            codes, counts = np.unique(narrow, return_counts=True)
        a, rest = np.divmod(codes, top * top)
        b, c = np.divmod(rest, top)
        return (a << 2 * _BITS) | (b << _BITS) | c, counts
    return np.unique(
        (padded[:-2] << 2 * _BITS) | (padded[1:-1] << _BITS) | padded[2:], return_counts=True)


class Codebook:
    """Trigram vectors, made when first met; a task starts anew beyond ``limit`` of them."""

    def __init__(self, dimensions: int = DIMENSIONS, limit: int = 30_000):
        self.dimensions, self.limit = dimensions, limit
        self.letter: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.rows = np.zeros((1024, dimensions), dtype=np.float32)

    def letter_vector(self, cp: int) -> np.ndarray:
        found = self.letter.get(cp)
        if found is None:
            bits = np.random.default_rng(cp + 1).integers(0, 2, self.dimensions)
            found = self.letter[cp] = (2 * bits - 1).astype(np.float32)
        return found

    def vector(self, code: int) -> np.ndarray:
        a, b, c = code >> 2 * _BITS, (code >> _BITS) & 0x1FFFFF, code & 0x1FFFFF
        return (np.roll(self.letter_vector(a), 2) * np.roll(self.letter_vector(b), 1)
                * self.letter_vector(c))

    def at(self, codes: np.ndarray) -> np.ndarray:
        """Row numbers of the codes in ``rows``."""
        if len(self.place) + len(codes) > self.limit:
            self.place, self.letter = {}, {}
        out = np.empty(len(codes), dtype=np.int64)
        for i, code in enumerate(codes.tolist()):
            k = self.place.get(code)
            if k is None:
                k = self.place[code] = len(self.place)
                if k >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[k] = self.vector(code)
            out[i] = k
        return out

    def bundle(self, text: str) -> np.ndarray | None:
        """The text's vector of length one, or None without a letter."""
        codes, counts = trigrams(text)
        if not len(codes):
            return None
        total = np.zeros(self.dimensions, dtype=np.float64)
        for i in range(0, len(codes), 4096):
            part = slice(i, i + 4096)
            places = self.at(codes[part])  # may make room in self.rows
            total += counts[part].astype(np.float32) @ self.rows[places]
        size = np.sqrt(total @ total)
        return total / size if size > 0 else None


@dataclass(frozen=True)
class Profiles:
    """Language names in order, and their centred prototypes of length one."""

    names: list[str]
    rows: np.ndarray

    def predict(self, vector: np.ndarray | None) -> tuple[str, float]:
        if vector is None or not self.names:
            return UNKNOWN, 0.0
        cosines = self.rows @ vector
        best = int(np.argmax(cosines))
        odds = np.exp(SHARPNESS * (cosines - cosines[best]))
        return self.names[best], float(1.0 / odds.sum())


def fit_profiles(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
    dimensions: int = DIMENSIONS, max_training: int = MAX_TRAINING,
    max_languages: int = MAX_LANGUAGES,
) -> Profiles:
    """Prototypes of all languages of the rows, from at most about ``max_training`` texts."""
    rows = docs.select(
        F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"),
        F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(1_000_000)).alias("_h"),
    ).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("_h").alias("least"))
    known = counts.limit(max_languages + 1).collect()
    if len(known) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if sum(r["n"] for r in known) > max_training:
        # A literal map of all languages: no text is shuffled.
        share = 1_000_000 * max_training / len(known)
        below = {r["lang"]: max(share / r["n"], r["least"] + 1.0) for r in known}
        limit = F.create_map(*[F.lit(v) for pair in below.items() for v in pair])
        rows = rows.where(F.col("_h") < F.element_at(limit, F.col("lang")))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, total = Codebook(dimensions), {}
        for batch in batches:
            for name, body in zip(batch["lang"], batch["text"]):
                v = book.bundle(body)
                if v is not None:
                    total[name] = total[name] + v if name in total else v
        if total:
            yield pd.DataFrame({"lang": list(total), "v": [v.tolist() for v in total.values()]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [group["lang"].iloc[0]],
                             "v": [np.sum(np.stack(group["v"].tolist()), axis=0)]})

    shape = "lang string, v array<double>"
    parts = rows.select("lang", "text").mapInPandas(sums, shape)
    parts = parts.withColumn("part", F.spark_partition_id() % 32)
    some = parts.groupBy("lang", "part").applyInPandas(added, shape)
    found = some.groupBy("lang").applyInPandas(added, shape).orderBy("lang").limit(
        max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not found:
        return Profiles([], np.zeros((0, dimensions)))
    names = [r["lang"] for r in found]
    made = np.array([r["v"] for r in found])
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    if len(names) > 1:
        made = made - made.mean(0)
        size = np.linalg.norm(made, axis=1, keepdims=True)
        made = made / np.where(size > 1e-12, size, 1.0)
    return Profiles(names, made)


def predicted_language(profiles: Profiles, text: Column) -> Column:
    """A struct of lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        book = Codebook(profiles.rows.shape[1])
        for batch in batches:
            out = [profiles.predict(None if t is None else book.bundle(t)) for t in batch]
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """All rows with lang_pred and score."""
    found = docs.withColumn("_found", predicted_language(profiles, F.col(f"`{text}`")))
    out = put(found, {"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")})
    return out.drop("_found")
