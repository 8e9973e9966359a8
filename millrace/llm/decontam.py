"""Benchmark decontamination: word-pair seeds, then Smith-Waterman alignment.

Test items are a stated query set. They go over the documents in blocks of at most ``BLOCK`` words of items, a fixed
size whatever the benchmark's, so a block and its seeds fit every task and all documents are read once a block, without
a shuffle. All pairs of neighbouring words of an item are its seeds, however many items have them: an alignment of m
words in r runs scores 2m - (r - 1) at most and has m - r pairs, so a score of g needs g - n - 1 pairs or more of an item
of n words. Where a document has as many close enough together, the words around them are aligned with the item, and the
alignment's score tells copies, edited and paraphrased ones included, from chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import give_back, pieces

#: Words of items in a block.
BLOCK = 2_000_000
#: Alignment scores: equal words, unequal words, a word without a partner.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's greatest possible score from which a document counts as holding it.
LEAST = 0.6
#: Words whose score an item must reach besides, so that a common phrase isn't an item; shorter items must be held whole.
WORDS = 8

FOUND = "array<struct<item_id: long, score: double, first_word: int, last_word: int>>"


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without the punctuation at their ends."""
    found = (word.strip(b".,;:!?\"'()[]{}<>|*#$%&-_") for word in text.encode("utf-8", "surrogatepass").lower().split())
    return [word for word in found if word]


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: its score, and the first and last word of the window in it.

    Row by row: what comes from above and across is set at once, what comes from the left is a running maximum, since
    a gap costs the same for each word. The start of the best alignment travels with its score in the low bits.
    """
    columns = len(window)
    shift = np.int64(1 << 32)
    steps = np.arange(columns, dtype=np.int64) * (-GAP) * shift
    starts = np.int64(1 << 31) - 1 - np.arange(columns, dtype=np.int64)  # earlier starts win ties
    above = np.zeros(columns, np.int64)
    best, where = np.int64(0), 0
    for word in item:
        gain = np.where(window == word, MATCH, MISMATCH).astype(np.int64) * shift
        across = np.empty(columns, np.int64)
        across[0], across[1:] = 0, above[:-1]
        across = np.where(across >= shift, across, starts) + gain
        now = np.maximum(across, above + GAP * shift)
        now = np.maximum.accumulate(now + steps) - steps
        now[now < shift] = 0
        above = now
        top = int(now.argmax())
        if now[top] >> 32 > best >> 32:
            best, where = now[top], top
    if not best:
        return 0, 0, -1
    return int(best >> 32), int((1 << 31) - 1 - (best & (int(shift) - 1))), where


class Items:
    """The items of a block: their words as numbers, and where their seeds are."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.numbers: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in rows:
            words = words_of(text or "")
            if words:
                self.items.append((item_id, np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int64)))
        self.sizes = np.array([len(words) for _, words in self.items], np.int64)
        # A pair is one number, its first word times the base and its second; an item of one word is that word's number.
        self.base = len(self.numbers) + 1
        seeds = [words[:-1] * self.base + words[1:] if len(words) > 1 else words for _, words in self.items]
        whole = np.concatenate(seeds) if seeds else np.zeros(0, np.int64)
        self.codes, inverse = np.unique(whole, return_inverse=True)
        self.ends = np.cumsum([len(seed) for seed in seeds], dtype=np.int64)
        self.own = inverse.astype(np.int32)  # item after item: which code its seeds have
        owner = np.repeat(np.arange(len(seeds), dtype=np.int32), [len(seed) for seed in seeds])
        self.owner = owner[np.argsort(inverse, kind="stable")]  # code after code: the items that have it
        self.starts = np.r_[0, np.cumsum(np.bincount(inverse, minlength=len(self.codes)))].astype(np.int64)
        self.single = bool((self.sizes == 1).any())

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The seeds among these words (0: a word of no item): their codes' numbers and their places, in order."""
        places = np.flatnonzero((words[:-1] > 0) & (words[1:] > 0))
        found = words[places] * self.base + words[places + 1]
        if self.single:
            alone = np.flatnonzero(words)
            places, found = np.r_[places, alone], np.r_[found, words[alone]]
        at = np.minimum(np.searchsorted(self.codes, found), len(self.codes) - 1)
        hit = self.codes[at] == found
        at, places = at[hit], places[hit]
        order = np.argsort(places, kind="stable")
        return at[order], places[order]

    def held(self, text: str, least: float) -> list[tuple[int, float, int, int]]:
        """Items that a text holds: id, share of the greatest score, first and last word."""
        number = self.numbers.get
        raw = words_of(text)
        words = np.fromiter((number(word, 0) for word in raw), np.int64, len(raw))
        if not len(words) or not len(self.codes) or not words.any():
            return []
        at, places = self.hits(words)
        if not len(at):
            return []
        codes = np.unique(at)
        many = self.starts[codes + 1] - self.starts[codes]
        flat = np.repeat(self.starts[codes] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        items, counts = np.unique(self.owner[flat], return_counts=True)
        sizes = self.sizes[items]
        goals = np.maximum(least * MATCH * sizes, MATCH * np.minimum(sizes, WORDS))
        needs = np.maximum(1, np.ceil(goals - sizes - 1 - 1e-9))
        out = []
        for k, goal, need in zip(*(x[counts >= needs].tolist() for x in (items, goals, needs)), strict=True):
            item_id, item = self.items[k]
            reach = int(np.ceil((3 - 2 * least) * len(item)))  # a word more costs a gap, so no passage is longer
            own = self.own[self.ends[k] - max(1, len(item) - 1) : self.ends[k]]
            mine = np.isin(at, own)
            seeds, at_places = at[mine], places[mine]
            best, first, last = 0, 0, -1
            # Windows that touch are one, so a passage lies in one of them with all its seeds.
            for part in np.split(np.arange(len(seeds)), np.flatnonzero(np.diff(at_places) > 2 * reach + 2) + 1):
                if np.isin(own, seeds[part]).sum() >= need:
                    begin, end = max(0, int(at_places[part[0]]) - reach), int(at_places[part[-1]]) + reach + 2
                    score, low, high = align(item, words[begin:end])
                    if score > best:
                        best, first, last = score, begin + low, begin + high
            if best >= goal - 1e-9:
                out.append((item_id, best / (MATCH * len(item)), first, last))
        return sorted(out)


def held_items(text: Column, block: Items, least: float = LEAST) -> Column:
    """The items of a block that each text holds, with score and first and last word; null texts hold none."""

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("item_id", "score", "first_word", "last_word")
        for texts in batches:
            yield pd.Series([[dict(zip(names, x, strict=True)) for x in block.held(value, least)] for held in pieces(texts) for value in held], dtype=object)
        give_back()

    return found(text)


def blocks(benchmark: DataFrame, text: str = "text", key: str = "item_id", words: int = BLOCK) -> Iterator[Items]:
    """The benchmark in blocks of at most ``words`` words (a longer item is a block of its own). Items are read one
    partition at a time; null ids and texts without words ask for nothing."""
    held: list[tuple[int, str]] = []
    size = 0
    for item_id, value in benchmark.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).toLocalIterator():
        more = value.count(" ") + value.count("\n") + 1
        if held and size + more > words:
            yield Items(held)
            held, size = [], 0
        held.append((item_id, value))
        size += more
    if held:
        yield Items(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", least: float = LEAST) -> DataFrame:
    """``key``, ``item_id``, ``score`` and the first and last word of the passage, a row for each test item that a row
    of ``docs`` holds at ``least`` or more of its greatest score. Repeated rows give repeated results; items of equal
    text are all named. Nothing for nulls, empty texts and empty tables."""
    out = None
    for block in blocks(benchmark):
        one = docs.select(F.col(key).alias("_id"), F.explode(held_items(F.col(text), block, least)).alias("_x"))
        one = one.select(F.col("_id").alias(key), "_x.*")
        out = one if out is None else out.union(one)
    if out is None:
        empty = F.lit(None).cast(FOUND)
        out = docs.where(F.lit(False)).select(F.col(key).alias("_id"), F.explode(empty).alias("_x")).select(F.col("_id").alias(key), "_x.*")
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` without the rows that hold a test item; columns stay as they are, nulls and empty texts stay."""
    for block in blocks(benchmark):
        docs = docs.where(F.size(held_items(F.col(text), block, least)) == 0)
    return docs
