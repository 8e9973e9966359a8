"""Quality by nearest neighbours in a latent-semantic space.

A text is a bag of terms: its words, the shapes of its words (case, marks, digits), and how words and lines repeat. The
terms of a bounded sample of labelled rows give a latent space by singular value decomposition; every document's vector
is compared with those of all labelled rows, exactly, in blocks of matrix products, and the nearest vote, each by its
similarity. The labelled vectors are bounded by the sample, so they go to every task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Remember, fold_of, pieces
from millrace.llm.toxicity import sample

#: Labelled rows to learn from: the first by a hash of their id, so many of each label. Scores cover all rows.
SAMPLE = {1: 2000, 0: 2000}
TERMS = 4096
DIMENSIONS = 48
NEAREST = 25
THRESHOLD = 0.3
#: Weight of words against that of shapes and repetitions.
WORDS = 0.3
#: The last terms are for repetition and length.
OTHER = 64


def shape(word: str) -> str:
    """A word with letters as a and A, digits as 9, and runs as one."""
    plain = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", plain)


def terms_of(word: str) -> tuple[int, int]:
    """Numbers of a word's own term and of its shape's."""
    half = (TERMS - OTHER) // 2
    own = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % half
    return own, half + zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % half


def counts(texts: list[str], memory: Remember) -> np.ndarray:
    """Weights of the terms of each text, before the weights of rarity."""
    rows = np.zeros((len(texts), TERMS), np.float32)
    for k, text in enumerate(texts):
        words = text.split()
        if words:
            pairs = np.array([memory[word] for word in words], np.int64)
            own = np.bincount(pairs[:, 0], minlength=TERMS)
            forms = np.bincount(pairs[:, 1], minlength=TERMS)
            rows[k] = WORDS * np.sqrt(own / len(words)) + np.sqrt(forms / len(words))
            again = sum(map(str.__eq__, words[1:], words)) / len(words)
            lines = [line for line in text.split("\n") if line.strip()]
            fresh = len(set(words)) / len(words)
            last = rows[k, TERMS - OTHER :]
            last[0], last[1], last[2] = np.sqrt(again), 1 - len(set(lines)) / max(1, len(lines)), 1 - fresh
            last[8 + min(11, int(10 * again))] = 0.5
            last[20 + min(10, int(10 * fresh))] = 0.5
            last[32 + min(15, len(words).bit_length())] = 0.3
            last[48 + min(15, len(lines).bit_length())] = 0.2
        else:
            rows[k, TERMS - 1] = 1.0
    return rows


@dataclass
class Neighbours:
    """Rarity of terms, axes of the latent space, and vectors, labels and weights of the labelled rows."""

    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; zero where a text shares nothing with it."""
        inside = (rows * self.rarity) @ self.axes
        length = np.linalg.norm(inside, axis=1, keepdims=True)
        return inside / np.where(length > 0, length, 1)

    def score(self, rows: np.ndarray, block: int = 512) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by similarity; the labels' own share if there are none."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        prior = float((self.labels * self.weights).sum() / self.weights.sum())
        out = np.empty(len(rows))
        nearest = min(NEAREST, len(self.labels))
        for start in range(0, len(rows), block):
            likeness = self.place(rows[start : start + block]) @ self.vectors.T
            best = np.argpartition(-likeness, nearest - 1, axis=1)[:, :nearest]
            # Similarities near 1 are told apart by their distance.
            near = np.take_along_axis(likeness, best, axis=1)
            votes = np.where(near > 0, near / (1.02 - np.minimum(near, 1.0)), 0) * self.weights[best]
            total = votes.sum(axis=1)
            out[start : start + block] = np.where(total > 0, (votes * self.labels[best]).sum(axis=1) / np.where(total > 0, total, 1), prior)
        return np.clip(out, 0.0, 1.0)


def train(texts: list[str], labels: np.ndarray, share: float) -> Neighbours:
    """``share``: that of label 1 among all labelled rows, which the sample needn't have."""
    memory = Remember(terms_of)
    rows = counts(texts, memory) if len(texts) else np.zeros((0, TERMS), np.float32)
    held = (rows > 0).sum(axis=0)
    rarity = (np.log((1 + len(rows)) / (1 + held)) + 0.2).astype(np.float32)
    labels = np.asarray(labels, np.float64)
    if not len(rows):
        return Neighbours(rarity, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, labels)
    weighted = rows * rarity
    # The leading axes by subspace iteration from a fixed start.
    basis = np.random.default_rng(11).standard_normal((TERMS, min(DIMENSIONS + 8, len(rows)))).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    _, _, turned = np.linalg.svd(weighted @ basis, full_matrices=False)
    axes = (basis @ turned.T)[:, :DIMENSIONS].astype(np.float32)
    ones = labels.mean()
    weights = np.where(labels == 1, share / max(ones, 1e-9), (1 - share) / max(1 - ones, 1e-9)) if 0 < ones < 1 else np.ones(len(labels))
    model = Neighbours(rarity, axes, np.zeros((0, axes.shape[1]), np.float32), labels, weights)
    model.vectors = model.place(rows).astype(np.float32)
    return model


def quality(text: Column, model: Neighbours) -> Column:
    """Score of each text, 0 to 1; a null is an empty text, which has a term of its own."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory = Remember(terms_of)
        for texts in batches:
            # Rows of terms are dense, so few texts at a time, however short they are.
            parts = [held[k : k + 512] for held in pieces(texts, 1_000_000) for k in range(0, len(held), 512)]
            yield pd.Series(np.concatenate([np.zeros(0), *(model.score(counts(part, memory)) for part in parts)]))

    return scores(text)


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", held_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` of each row. A null key isn't held out."""
    model = train(*sample(docs, labels, "quality", SAMPLE, held_out, text, key))
    out = F.coalesce(fold_of(key, held_out[0]) == held_out[1], F.lit(False)).alias("held_out")
    rows = docs.select(F.col(key), out, quality(F.col(text), model).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
