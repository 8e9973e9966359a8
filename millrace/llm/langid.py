"""Languages of a document as a mixture, inferred by expectation-maximisation.

Each language is a smoothed model of character trigrams, counted over all training documents. A word's likelihood under
a language is that of its trigrams; a document is a mixture of languages, whose proportions are found by
expectation-maximisation over its words. How many languages it has is decided by the likelihood less a penalty for each
language more: the likeliest one first, then the next by proportion for as long as it pays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold_of, pieces

#: Bins of trigrams; each language's model has as many numbers, whatever the corpus.
BINS = 1 << 16
#: Added to each bin's count.
SMOOTH = 0.1
ROUNDS = 8
#: A word's trigrams overlap, so its log likelihood counts by this part only.
TEMPER = 1 / 3
NONE = "und"


def letters() -> np.ndarray:
    """Whether each code point is a letter, as a table."""
    return np.fromiter((chr(point).isalpha() for point in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of all trigrams of words, lower-cased and with an edge on either side; where words begin among them; and the
    document of each word."""
    joined = "\n".join(text.lower() for text in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.concatenate([np.zeros(1, np.uint32), points])
    word = alphabet[points]
    clean = np.where(word, points, 0).astype(np.uint64)
    # A trigram around each letter; its neighbours are letters or edges.
    middle = np.flatnonzero(word)
    if not len(middle):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (clean[middle - 1] * np.uint64(0x9E3779B1) + clean[middle]) * np.uint64(0x85EBCA77C2B2AE63) + clean[middle + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    bins = (mixed >> np.uint64(48)).astype(np.int64)
    begins = np.flatnonzero(~word[middle - 1])
    ends = np.cumsum(np.array([len(text.lower()) + 1 for text in texts]))  # where documents end among the points
    owner = np.searchsorted(ends, middle[begins] - 1, side="right")
    return bins, begins, owner


@dataclass
class Languages:
    """Trained languages in alphabetical order, and the log probability of each bin under each."""

    names: list[str]
    logs: np.ndarray

    def mixtures(self, texts: list[str], alphabet: np.ndarray) -> list[dict[str, float]]:
        """Proportions of the languages of each text, those of its chosen set only; none without letters."""
        found: list[dict[str, float]] = [{} for _ in texts]
        bins, begins, owner = trigrams(texts, alphabet)
        if not len(begins) or not self.names:
            return found
        words = np.add.reduceat(self.logs[bins], begins, axis=0) * TEMPER
        many = np.bincount(owner, minlength=len(texts))
        worded = np.flatnonzero(many)
        starts = (np.cumsum(many) - many)[worded]
        place = np.repeat(np.arange(len(worded)), many[worded])
        if len(self.names) == 1:
            return [{self.names[0]: 1.0} if n else {} for n in many]
        single = np.add.reduceat(words, starts, axis=0)
        shares, whole = self.fit(words, starts, place, np.full((len(worded), len(self.names)), 1 / len(self.names)))
        # Sets of one, two, ... languages, the largest shares first; the best penalised likelihood stays.
        order = np.argsort(-shares, axis=1, kind="stable")
        best_one = single.argmax(axis=1)
        price = np.log(many[worded]) / 2 + 2.0
        best = single.max(axis=1) - price
        chosen = np.zeros_like(shares)
        chosen[np.arange(len(worded)), best_one] = 1.0
        open_docs = np.flatnonzero(whole - 2 * price > best)
        for size in range(2, len(self.names) + 1):
            if not len(open_docs):
                break
            rows = np.isin(place, open_docs)
            sizes = many[worded][open_docs]
            begin = np.cumsum(sizes) - sizes
            start = np.zeros((len(open_docs), len(self.names)))
            np.put_along_axis(start, order[open_docs, :size], 1 / size, axis=1)
            fitted, likely = self.fit(words[rows], begin, np.repeat(np.arange(len(open_docs)), sizes), start)
            better = likely - size * price[open_docs] > best[open_docs]
            best[open_docs[better]] = (likely - size * price[open_docs])[better]
            chosen[open_docs[better]] = fitted[better]
            open_docs = open_docs[whole[open_docs] - (size + 1) * price[open_docs] > best[open_docs]]
        for k, doc in enumerate(worded.tolist()):
            found[doc] = {self.names[j]: float(chosen[k, j]) for j in np.flatnonzero(chosen[k] > 0)}
        return found

    @staticmethod
    def fit(words: np.ndarray, starts: np.ndarray, place: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions by expectation-maximisation from ``shares``, and the log likelihood they reach."""
        top = words.max(axis=1, keepdims=True)
        likely = np.exp(words - top)
        many = np.diff(np.append(starts, len(words)))[:, None]
        for _ in range(ROUNDS):
            parts = likely * shares[place]
            parts /= np.maximum(parts.sum(axis=1, keepdims=True), 1e-300)
            shares = np.add.reduceat(parts, starts, axis=0) / many
        mixed = np.log(np.maximum((likely * shares[place]).sum(axis=1), 1e-300)) + top[:, 0]
        return shares, np.add.reduceat(mixed, starts)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """Models from all rows that have a text and a language. Trigrams are counted where the rows lie; a number per
    language and used bin reaches the driver."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alphabet, sums = letters(), {}
        for rows in batches:
            for name, own in rows.groupby("_lang")["_text"]:
                total = sums.setdefault(name, np.zeros(BINS, np.int64))
                for held in pieces(own):
                    total += np.bincount(trigrams(held, alphabet)[0], minlength=BINS)
        for name, total in sums.items():
            used = np.flatnonzero(total)
            yield pd.DataFrame({"_lang": name, "_bin": used.astype(np.int32), "_n": total[used]})

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    sums = rows.mapInPandas(counted, "_lang string, _bin int, _n long").groupBy("_lang", "_bin").agg(F.sum("_n").alias("_n")).toPandas()
    names = sorted(sums["_lang"].unique())
    logs = np.zeros((BINS, len(names)))
    for k, name in enumerate(names):
        own = sums[sums["_lang"] == name]
        total = np.full(BINS, SMOOTH)
        total[own["_bin"]] += own["_n"]
        logs[:, k] = np.log(total / total.sum())
    return Languages(names, logs.astype(np.float32).astype(np.float64))


def languages(text: Column, model: Languages) -> Column:
    """Array of (lang, share), the largest share first, for each text; empty for nulls and texts without letters."""

    @F.pandas_udf("array<struct<lang: string, share: double>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        alphabet = letters()
        for texts in batches:
            rows = [x for held in pieces(texts, 1_000_000) for x in model.mixtures(held, alphabet)]
            ranked = [sorted(row.items(), key=lambda x: (-x[1], x[0])) for row in rows]
            yield pd.Series([[{"lang": name, "share": min(1.0, share)} for name, share in row] for row in ranked], dtype=object)

    return found(text)


def predicted(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """``key``, ``held_out``, ``lang_pred``, ``score`` (the share of that language) and ``langs`` (all chosen ones, joined by
    commas) of each row. Learned from the rows that aren't held out; ``und`` with score 0 for nulls, texts without
    letters, and where nothing could be learned. A null key isn't held out."""
    out = F.coalesce(fold_of(key, held_out[0]) == held_out[1], F.lit(False))
    model = train(docs.where(~out), text, lang)
    rows = docs.select(F.col(key), out.alias("held_out"), languages(F.col(text), model).alias("_found"))
    first = F.get("_found", F.lit(0))
    return rows.select(
        key,
        "held_out",
        F.coalesce(first["lang"], F.lit(NONE)).alias("lang_pred"),
        F.coalesce(first["share"], F.lit(0.0)).alias("score"),
        F.array_join(F.col("_found.lang"), ",").alias("langs"),
    )
