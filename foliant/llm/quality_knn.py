"""Quality by nearest labelled neighbours in a latent semantic space.

Texts are bags of terms: words, the shapes of words (letters, digits and marks collapsed) and
immediate repetitions, hashed to fixed numbers. Weighted by tf-idf and projected on the leading singular
vectors of the labelled texts, they become latent vectors. Every document is compared with all labelled
vectors, block by block, by exact cosine in double precision; the ``k`` nearest vote with the weight of their similarity,
ties (equal to ``DIGITS`` decimals) to the first of the sample, which is in order of ids.
The labelled vectors are bounded by a parameter, so they go to every task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Seen, kept, map_texts, read, slices, text_columns
from .labelled import held_out, labelled_sample

WORDS, SHAPES = 4096, 1023
TERMS = WORDS + SHAPES + 1
REPEAT = TERMS - 1
DIGITS = 12  # cosines that agree in so many decimals are equal
_RUNS = [(re.compile(r"[^\W\d_]+"), lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "Aa" if m[0][0].isupper() else "a"), (re.compile(r"\d+"), lambda m: "0"), (re.compile(r"([^\w\s])\1{2,}"), lambda m: m[1] * 3)]
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def shape(word: str) -> str:
    for pattern, to in _RUNS:
        word = pattern.sub(to, word)
    return word


class Terms:
    """Term numbers of texts; those of words seen before are kept, ``most`` at most."""

    def __init__(self, most: int = 2_000_000):
        self.most, self.seen = most, Seen(np.int64)

    @staticmethod
    def _learn(words: pa.Array) -> np.ndarray:
        words = words.to_pylist()
        a = np.fromiter((zlib.crc32(w.lower().strip(_MARKS).encode()) % WORDS for w in words), np.int64, len(words))
        b = np.fromiter((zlib.crc32(shape(w).encode()) % SHAPES for w in words), np.int64, len(words))
        return a * TERMS + WORDS + b

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of all texts, in order of rows."""
        if len(self.seen) > self.most:
            self.seen = Seen(np.int64)
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        n = words.value_lengths().to_numpy(zero_copy_only=False)
        flat = words.flatten()
        coded = flat.dictionary_encode()
        both = self.seen.values(coded.dictionary, self._learn)[coded.indices.to_numpy()]
        row = np.repeat(np.arange(len(n)), n)
        full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty word
        both, row = both[full], row[full]
        same = (both[1:] == both[:-1]) & (row[1:] == row[:-1])
        key = np.concatenate([row * TERMS + both // TERMS, row * TERMS + both % TERMS, row[1:][same] * TERMS + REPEAT])
        key, count = np.unique(key, return_counts=True)
        return key // TERMS, key % TERMS, count


class Neighbours:
    """Labelled latent vectors with their labels."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, y: np.ndarray, k: int, power: float):
        self.idf, self.basis, self.vectors, self.y, self.k, self.power = idf, basis, vectors, y, k, power
        self.terms = Terms()

    def latent(self, texts: pa.Array) -> np.ndarray:
        """Latent vectors of length 1; zeros for a text without words."""
        row, term, count = self.terms(texts)
        out = np.zeros((len(texts), self.basis.shape[1]))
        if len(row):
            weight = np.sqrt(count) * self.idf[term]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            for at in range(0, len(first), 256):  # a few documents at a time: their terms times the dimensions
                a, z = first[at], first[at + 256] if at + 256 < len(first) else len(row)
                out[row[first[at : at + 256]]] = np.add.reduceat(weight[a:z, None] * self.basis[term[a:z]], first[at : at + 256] - a)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(length, 1e-12)

    def vote(self, texts: pa.Array) -> np.ndarray:
        """Weighted share of label 1 among the nearest; 0 for a text without words or without neighbours."""
        x = self.latent(texts)
        out = np.zeros(len(texts))
        if not len(self.y):
            return out
        k = min(self.k, len(self.y))
        for at in range(0, len(x), 256):
            cosine = np.round(x[at : at + 256] @ self.vectors.T, DIGITS)
            worst = np.partition(cosine, len(self.y) - k, axis=1)[:, len(self.y) - k, None]
            sure = cosine > worst
            # Of those as near as the k-th, the first of the sample fill the places that are left.
            row, one = np.nonzero(cosine == worst)
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            fill = nth < (k - sure.sum(1))[row]
            sure[row[fill], one[fill]] = True
            weight = np.where(sure, np.maximum(cosine, 0), 0) ** self.power
            out[at : at + 256] = (weight @ self.y) / np.maximum(weight.sum(1), 1e-12)
        return np.clip(out, 0, 1)


def train(sample: list[tuple[str, int]], dim: int = 64, k: int = 15, power: float = 8.0, shape_weight: float = 2.0, seed: int = 42) -> Neighbours:
    """Neighbours from (text, label) pairs."""
    texts, y = pa.array([t for t, _ in sample], pa.string()), np.array([label for _, label in sample], float)
    row, term, count = Terms()(texts)
    n = max(1, len(texts))
    idf = (np.log((n + 1) / (np.bincount(term, minlength=TERMS) + 1)) + 0.1).astype(np.float32)
    idf[WORDS:] *= shape_weight
    idf[REPEAT] *= 2
    a = np.zeros((n, TERMS), np.float32)
    a[row, term] = np.sqrt(count) * idf[term]
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    # Truncated SVD by subspace iteration.
    dim = min(dim, n)
    q = np.random.default_rng(seed).normal(size=(TERMS, dim)).astype(np.float32)
    for _ in range(6):
        q = np.linalg.qr(a.T @ (a @ q))[0]
    _, _, turn = np.linalg.svd(a @ q, full_matrices=False)
    basis = (q @ turn.T).astype(np.float32)
    out = Neighbours(idf, basis, np.zeros((0, dim)), y, k, power)
    del a
    out.vectors = np.concatenate([out.latent(texts.slice(at, m)) for at, m in slices(texts)]) if len(texts) else out.vectors
    out.terms = Terms()
    return out


def _scored(model: Neighbours, text_col: str, width: int):
    key = ("quality", len(model.y), float(model.vectors.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(key, lambda: model)
        for b in batches:
            value = [own.vote(b.column(text_col).slice(at, n)) for at, n in slices(b.column(text_col))]
            score = pa.array(np.concatenate(value) if value else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:width], score], [*b.schema.names[:width], "quality"])

    return run


def score_quality(df: DataFrame, labels: DataFrame, text_col: str = "text", most_good: int = 2000, most_poor: int = 1000, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with quality (double, 0 to 1).

    Learns from at most ``most_good`` and ``most_poor`` documents of ``df`` that ``labels`` (doc_id,
    quality) marks. Null, empty and wordless texts score 0, and so does every text when no label is
    there. Rows may repeat; a column named quality is replaced. Empty in, empty out.
    """
    model = train(labelled_sample(df.withColumnRenamed(text_col, "text"), labels, "quality", {0: most_poor, 1: most_good}))
    keep = [c for c in (keep or df.columns) if c != "quality"]
    slim = text_columns(df, keep, text_col)
    return map_texts(slim, _scored(model, text_col, len(keep)), slim.select(*keep, F.lit(0.0).alias("quality")).schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))
