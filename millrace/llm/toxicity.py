"""Toxic spans by a linear-chain conditional random field over words, and document scores from its marginals.

Labels are given per document, so the words to learn from are marked first: the fewest words and beginnings of words
that explain the toxic documents of a bounded sample and hardly occur in the others (``marked``). The field then learns
from whole marked documents what toxic words look like (the word, its beginnings and its end) and how they follow each
other. Forward and backward messages over all documents of a batch are run in blocks of words at once; they are exact.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Remember, fold_of, give_back, pieces

#: Labelled rows to learn from: the first by a hash of their id, so many of each label. Scores cover all rows.
SAMPLE = {1: 2000, 0: 3000}
#: Documents that must hold a word, or a beginning, before it can mark.
SUPPORT = 3
THRESHOLD = 0.3
WORD = re.compile(r"\w+")
#: Words in a block of the message passing.
WIDE = 128


def features(word: str) -> list[int]:
    """What the field knows about a word, as numbers of 32 bits: itself, its beginnings and its end."""
    word = word.lower()
    names = (word, *(f"{word[:k]}*" for k in range(3, 8) if len(word) > k), f"*{word[-3:]}" if len(word) > 3 else "*")
    return [zlib.crc32(name.encode("utf-8", "surrogatepass")) for name in names]


def tokens(text: str) -> list[str]:
    return WORD.findall(text)


def _padded(values: np.ndarray, fill: float) -> np.ndarray:
    rows = max(1, -(-len(values) // WIDE))
    out = np.full(rows * WIDE, fill)
    out[: len(values)] = values
    return np.ascontiguousarray(out.reshape(rows, WIDE).T)


def _odds_through(top: np.ndarray, bottom: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """r[t] = (top[t] r[t-1] + bottom[t]) / (left[t] r[t-1] + right[t]) from r = 0 on, for all t.

    Words stand in blocks, one below the other: the blocks' products are found side by side, each block's entry
    follows from the one before, then all blocks are walked side by side again.
    """
    size = len(top)
    a, b, c, d = _padded(top, 1.0), _padded(bottom, 0.0), _padded(left, 0.0), _padded(right, 1.0)
    blocks = a.shape[1]
    p, q, r, s = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for t in range(WIDE):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        scale = 1.0 / (p + q + r + s)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    enter = np.zeros(blocks)
    now = 0.0
    for k, (pk, qk, rk, sk) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        enter[k] = now
        now = (pk * now + qk) / (rk * now + sk)
    out = np.empty((WIDE, blocks))
    now = enter
    for t in range(WIDE):
        now = (a[t] * now + b[t]) / (c[t] * now + d[t])
        out[t] = now
    return out.T.reshape(-1)[:size]


def marginals(unary: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of the toxic state for each word. ``unary``: log-odds of the words; ``starts``: whether a document
    begins there; ``moves``: log weights of plain-toxic, toxic-toxic and toxic-plain (plain-plain: 0)."""
    if not len(unary):
        return np.zeros(0)
    odds = np.exp(np.clip(unary, -30, 30))
    into, stay, back = np.exp(np.clip(moves, -15, 15))
    first = starts.astype(bool)
    # Forward odds: a start forgets what was before.
    forward = _odds_through(np.where(first, 0.0, odds * stay), odds * into, np.where(first, 0.0, back), np.ones(len(odds)))
    # Backward odds, from the end: beta[t] from beta[t + 1] and the word there; after a last word both are even.
    last = np.append(first[1:], True)[::-1]
    next_odds = np.append(odds[1:], 1.0)[::-1]
    backward = _odds_through(
        np.where(last, 0.0, stay * next_odds), np.where(last, 1.0, back), np.where(last, 0.0, into * next_odds), np.ones(len(odds))
    )[::-1]
    both = forward * backward
    return both / (1 + both)


@dataclass
class Field:
    """A trained field: weights by feature, moves between states, and what turns marginals into a document's score."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -8.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros(3))
    ends: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0, 0.0]))

    def log_odds(self, word: str) -> float:
        got = self.weights.get
        return self.bias + sum(got(name, 0.0) for name in features(word))

    def of_documents(self, texts: list[str], memory: Remember) -> tuple[list[np.ndarray], np.ndarray]:
        """The words' marginals and the score of each text."""
        found = [tokens(text) for text in texts]
        sizes = np.array([len(words) for words in found], np.int64)
        unary = np.fromiter((memory[word] for words in found for word in words), np.float64, int(sizes.sum()))
        starts = np.zeros(len(unary), bool)
        begins = np.cumsum(sizes) - sizes
        starts[begins[sizes > 0]] = True
        chances = marginals(unary, starts, self.moves)
        each = np.split(chances, np.cumsum(sizes)[:-1]) if len(texts) else []
        return each, self.score(summary(each))

    def score(self, seen: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.ends[0] + seen @ self.ends[1:], -30, 30)))


def summary(each: list[np.ndarray]) -> np.ndarray:
    """For each document: the chance that any word is toxic, as a sum of -log(1 - p), and the expected share of them."""
    rows = np.zeros((len(each), 2))
    for k, chances in enumerate(each):
        if len(chances):
            rows[k] = min(10.0, -np.log1p(-np.minimum(chances, 1 - 1e-9)).sum()), min(1.0, 100 * chances.mean())
    return rows


def marked(docs: list[np.ndarray], toxic: np.ndarray, begin: np.ndarray, names: np.ndarray, total: int) -> set[int]:
    """Features that mark toxic words: taken one after the other, always the one that explains most of the toxic
    documents left, as long as it hardly occurs in other documents. ``docs``: words of each document; a word's features are
    the numbers below ``total`` that stand in ``names`` from its ``begin`` on."""

    def seen(words: np.ndarray) -> np.ndarray:
        words = np.unique(words)
        sizes = begin[words + 1] - begin[words]
        places = np.repeat(begin[words] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return np.unique(names[places])

    bad, good = np.zeros(total, np.int32), np.zeros(total, np.int32)
    for words, label in zip(docs, toxic, strict=True):
        (bad if label else good)[seen(words)] += 1
    ratio = max(1, toxic.sum()) / max(1, (~toxic).sum())
    usable = (bad >= SUPPORT) & (good * ratio <= 0.02 * bad)
    chosen: set[int] = set()
    open_docs = [own[usable[own]] for own in (seen(words) for words, label in zip(docs, toxic, strict=True) if label)]
    while True:
        left = np.bincount(np.concatenate([np.zeros(0, np.int64), *open_docs]), minlength=total)
        best = int(left.argmax()) if total else 0
        if not total or left[best] < SUPPORT:
            return chosen
        chosen.add(best)
        open_docs = [own for own in open_docs if best not in own]


def _fit_logistic(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 0.01, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps, with a constant first."""
    x = np.column_stack([np.ones(len(rows)), rows])
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weights * (labels - p)) - ridge * beta
        curve = (x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return beta


def train(texts: list[str], toxic: np.ndarray, share: float, rounds: int = 25) -> Field:
    """Fit a field to labelled documents. ``share``: that of toxic documents among all labelled ones."""
    model = Field()
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        model.ends = np.array([20.0 if len(toxic) and toxic.all() else -4.0, 0.0, 0.0])
        return model
    words: dict[str, int] = {}
    docs = [np.array([words.setdefault(w.lower(), len(words)) for w in tokens(text)], np.int32) for text in texts]
    own = [features(word) for word in words]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
    numbers, names = np.unique(np.array([n for x in own for n in x], np.uint32), return_inverse=True)
    del own
    names, total, vocabulary = names.astype(np.int32), len(numbers), len(words)
    signs = marked(docs, toxic, begin, names, total)
    sign = np.zeros(total + 1, bool)
    sign[list(signs)] = True
    word_of = np.repeat(np.arange(vocabulary, dtype=np.int32), np.diff(begin))
    marks = np.bincount(word_of, weights=sign[names], minlength=vocabulary) > 0
    # The field is fitted to all words of the sample, a part of the documents at a time.
    parts = []
    for start in range(0, len(docs), 250):
        some, label = docs[start : start + 250], toxic[start : start + 250]
        flat = np.concatenate(some)
        sizes = np.array([len(doc) for doc in some])
        starts = np.zeros(len(flat), bool)
        starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        parts.append((flat, starts, marks[flat] & np.repeat(label, sizes)))
    hits, many, pairs = np.zeros(vocabulary), np.zeros(vocabulary), np.zeros(3)
    for flat, starts, truth in parts:
        many += np.bincount(flat, minlength=vocabulary)
        hits += np.bincount(flat, weights=truth, minlength=vocabulary)
        inner = ~starts[1:]
        pairs += [(~truth[:-1] & truth[1:] & inner).sum(), (truth[:-1] & truth[1:] & inner).sum(), (truth[:-1] & ~truth[1:] & inner).sum()]
    toxic_words, plain_words = hits.sum(), many.sum() - hits.sum()
    if not toxic_words:
        model.ends = np.array([np.log(share / (1 - share)) if 0 < share < 1 else 0.0, 0.0, 0.0])
        return model
    moves = np.log((pairs + 0.5) / np.array([plain_words + 1, toxic_words + 1, toxic_words + 1]))
    plain = np.log1p(-(pairs[0] + 0.5) / (plain_words + 1))
    model.moves = np.array([0.0, moves[1] - moves[0] - plain, moves[2] - plain])  # the rest of the way in is the bias's
    weights, bias = np.zeros(total), np.log(toxic_words / max(plain_words, 1.0))
    speed, speed_bias, speed_moves = np.full(total, 1e-3), 1e-3, np.full(3, 1e-3)
    for _ in range(rounds):  # adaptive gradient ascent on the likelihood, every word weighing the same
        scores = bias + np.bincount(word_of, weights=weights[names], minlength=vocabulary)
        word_gap, gaps = hits.copy(), pairs - 0.05 * model.moves
        for flat, starts, _ in parts:
            chances = marginals(scores[flat], starts, model.moves)
            word_gap -= np.bincount(flat, weights=chances, minlength=vocabulary)
            # How often states follow each other, as the marginals of neighbours have it, against the marked words.
            inner = ~starts[1:]
            left, right = chances[:-1][inner], chances[1:][inner]
            gaps = gaps - [((1 - left) * right).sum(), (left * right).sum(), (left * (1 - right)).sum()]
        gap = np.bincount(names, weights=word_gap[word_of], minlength=total) - 0.05 * weights
        speed += gap * gap
        weights += 0.5 * gap / np.sqrt(speed)
        gap_bias = word_gap.sum() - 0.05 * bias
        speed_bias += gap_bias**2
        bias += 0.5 * gap_bias / np.sqrt(speed_bias)
        gaps[0] = 0.0
        speed_moves += gaps**2
        model.moves = model.moves + 0.1 * gaps / np.sqrt(speed_moves)
    kept = np.flatnonzero(np.abs(weights) > 0.1)
    model.weights = dict(zip(numbers[kept].tolist(), weights[kept].tolist(), strict=True))
    model.bias = float(bias)
    del words, docs, parts
    memory = Remember(model.log_odds)
    seen_docs = np.concatenate([summary(model.of_documents(texts[k : k + 200], memory)[0]) for k in range(0, len(texts), 200)])
    even = np.where(toxic, share / max(1e-9, toxic.mean()), (1 - share) / max(1e-9, 1 - toxic.mean()))
    model.ends = _fit_logistic(seen_docs, toxic.astype(float), even)
    return model


def sample(docs: DataFrame, labels: DataFrame, label: str, sizes: dict[int, int], held_out: tuple[int, int], text: str = "text", key: str = "doc_id") -> tuple[list[str], np.ndarray, float]:
    """Texts and labels to learn from: of each label the ``sizes[label]`` rows that come first by a hash of the key,
    none of the held-out fold (folds, fold). Also the share of label 1 among all that are not held out.

    The sample is bounded by ``sizes``; only its keys are joined to the documents, so the texts aren't shuffled. Rows with
    a null key, label or text teach nothing; a key labelled twice counts by its greater label.
    """
    folds, out = held_out
    own = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).where(fold_of(key, folds) != out)
    own = own.groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    many = {row["_label"]: row["n"] for row in own.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for value, size in sizes.items():
        some = own.where(F.col("_label") == value).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(size)
        chosen = some if chosen is None else chosen.union(some)
    ids = {row["_id"]: row["_label"] for row in chosen.collect()}
    spark = docs.sparkSession
    if not ids:
        return [], np.zeros(0, int), 0.0
    small = spark.createDataFrame([(k, v) for k, v in ids.items()], f"_id {docs.schema[key].dataType.simpleString()}, _label int")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    rows = rows.join(F.broadcast(small), "_id").select("_id", "_text", "_label").collect()
    rows.sort(key=lambda row: (row["_id"], row["_text"]))
    share = many.get(1, 0) / max(1, many.get(0, 0) + many.get(1, 0))
    return [row["_text"] for row in rows], np.array([row["_label"] for row in rows], int), share


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", held_out: tuple[int, int] = (4, 2)) -> Field:
    texts, toxic, share = sample(docs, labels, "toxic", SAMPLE, held_out, text, key)
    return train(texts, toxic, share)


def toxicity(text: Column, model: Field) -> Column:
    """Score of each text, 0 to 1; nulls and empty texts score as texts without toxic words do."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory = Remember(model.log_odds)
        for texts in batches:
            yield pd.Series(np.concatenate([np.zeros(0), *(model.of_documents(held, memory)[1] for held in pieces(texts))]))
        memory.clear()
        give_back()

    return scores(text)


SPANS = "array<struct<start: int, end: int, toxicity: double>>"


def runs_of(value: str, chances: np.ndarray, least: float) -> list[dict]:
    """Runs of words of a text whose marginal is ``least`` or more, with the greatest marginal of each."""
    runs: list[dict] = []
    if not len(chances) or chances.max() < least:
        return runs
    before = -2
    for k, found in enumerate(WORD.finditer(value)):
        if chances[k] < least:
            continue
        if before == k - 1:
            runs[-1]["end"] = found.end()
            runs[-1]["toxicity"] = max(runs[-1]["toxicity"], float(chances[k]))
        else:
            runs.append({"start": found.start(), "end": found.end(), "toxicity": float(chances[k])})
        before = k
    return runs


def judged(text: Column, model: Field, least: float = 0.5) -> Column:
    """``score`` as :func:`toxicity` gives it and ``spans``, the offsets (code points, end exclusive) of runs of words whose
    marginal is ``least`` or more, from one pass over the text. Nulls and empty texts have no spans."""

    @F.pandas_udf(f"score: double, spans: {SPANS}")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memory = Remember(model.log_odds)
        for texts in batches:
            scores, spans = [np.zeros(0)], []
            for held in pieces(texts):
                chances, found = model.of_documents(held, memory)
                scores.append(found)
                spans.extend(runs_of(value, each, least) for value, each in zip(held, chances, strict=True))
            yield pd.DataFrame({"score": np.concatenate(scores), "spans": pd.Series(spans, dtype=object)})
        memory.clear()
        give_back()

    return both(text)


def toxic_spans(text: Column, model: Field, least: float = 0.5) -> Column:
    """The ``spans`` of :func:`judged` alone."""
    return judged(text, model, least)["spans"]


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``held_out``, ``score``, ``predicted`` and ``spans`` (offending offsets) of each row, repeated rows included.

    A null key isn't held out. Null and empty texts have the score of texts without toxic words and no spans; texts of any
    length are scored whole. Equal texts are judged alike. An empty table has no rows; without labels to learn from every row
    has one score. Other columns of ``docs`` are left out, whatever their names.
    """
    model = fit(docs, labels, text, key)
    rows = docs.select(F.col(key), F.coalesce(fold_of(key, 4) == 2, F.lit(False)).alias("held_out"), judged(F.col(text), model).alias("_judged"))
    score = F.col("_judged.score")
    return rows.select(key, "held_out", score.alias("score"), F.when(score >= THRESHOLD, 1).otherwise(0).alias("predicted"), F.col("_judged.spans").alias("spans"))


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that score ``THRESHOLD`` or more; columns stay as they are."""
    return docs.where(toxicity(F.col(text), fit(docs, labels, text, key)) < THRESHOLD)
