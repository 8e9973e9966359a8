"""Byte-level BPE: whole texts to token ids and back.

Texts are cut into pieces as the vocabulary's own rules say; each piece is merged with a segment tree over the ranks of
its adjacent pairs. The root names the leftmost pair of lowest rank, a merge changes three leaves, and each change
costs the logarithm of the piece's length, so a piece of a million characters takes n log n steps.

Rows are worked on one by one where they lie: no shuffle, nothing kept per task but the vocabulary and a bounded memory
of pieces already merged.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Remember, give_back, in_pieces

#: The shift between a rank and a position in one number; a piece has fewer than 2**40 bytes.
PLACE = 40
NONE = 1 << 100

#: Pieces, and words, that a task remembers the ids of, twice over at most: some 250 MB.
REMEMBERED = 250_000
#: Characters of texts worked on at once.
PIECE = 1_000_000

SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class PairTree:
    """Segment tree over the pairs of neighbours in a piece; a leaf holds rank and position of the pair that starts
    there in one number, so that the least is the leftmost of the lowest rank."""

    def __init__(self, keys: list[int]):
        self.leaves = leaves = 1 << max(0, len(keys) - 1).bit_length()
        self.tree = tree = [NONE] * leaves + keys + [NONE] * (leaves - len(keys))
        for node in range(leaves - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right

    def least(self) -> int:
        return self.tree[1]

    def put(self, place: int, key: int) -> None:
        tree, node = self.tree, self.leaves + place
        tree[node] = key
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left < right else right
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1


def merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Symbols after all merges. ``ranks``: a pair's rank and the symbol it becomes."""
    size = len(symbols)
    if size < 2:
        return symbols
    symbols = list(symbols)
    got = ranks.get
    keys = []
    for place in range(size - 1):
        found = got((symbols[place], symbols[place + 1]))
        keys.append(found[0] << PLACE | place if found else NONE)
    tree = PairTree(keys)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    alive = (1 << PLACE) - 1
    while (key := tree.least()) != NONE:
        left = key & alive
        right = after[left]
        symbols[left] = ranks[symbols[left], symbols[right]][1]
        symbols[right] = -1
        after[left] = follow = after[right]
        if right < size - 1:
            tree.put(right, NONE)
        if follow < size:
            before[follow] = left
            found = got((symbols[left], symbols[follow]))
            tree.put(left, found[0] << PLACE | left if found else NONE)
        else:
            tree.put(left, NONE)
        if (back := before[left]) >= 0:
            found = got((symbols[back], symbols[left]))
            tree.put(back, found[0] << PLACE | back if found else NONE)
    return [symbol for symbol in symbols if symbol >= 0]


class ManyTrees:
    """The same for many short pieces side by side: one row of arrays each, a merge in every unfinished piece at a time."""

    #: No pair; above all rank-and-place numbers, the place in the six low bits.
    NONE = 1 << 30

    def __init__(self, first: list[int], ranks: dict[tuple[int, int], tuple[int, int]]):
        self.first = np.array(first, np.int64)
        pairs = sorted((left << 20 | right, rank) for (left, right), (rank, _) in ranks.items())
        self.pairs = np.array([pair for pair, _ in pairs] or [-1], np.int64)
        self.rank = np.array([rank for _, rank in pairs] or [0], np.int64)
        self.made = np.zeros(max((rank for _, rank in pairs), default=0) + 1, np.int64)
        for rank, symbol in ranks.values():
            self.made[rank] = symbol
        self.usable = len(self.made) < self.NONE >> 6

    def keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        asked = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, asked), len(self.pairs) - 1)
        return np.where(self.pairs[at] == asked, self.rank[at] << 6 | place, self.NONE)

    def merge(self, pieces: list[bytes], leaves: int) -> list[tuple[int, ...]]:
        """Symbols of pieces of 1 to ``leaves`` (a power of two, at most 64) bytes."""
        many = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, many)
        rows, places = np.repeat(np.arange(many), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        nothing = (1 << 20) - 1
        symbols = np.full((many, leaves + 1), nothing, np.int64)
        symbols[rows, places] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, leaves + 2), (many, 1))
        before = np.tile(np.arange(-1, leaves), (many, 1))
        after[np.arange(many), sizes - 1] = leaves
        tree = np.full((many, 2 * leaves), self.NONE, np.int32)
        tree[rows, leaves + places] = self.keys(symbols[rows, places], symbols[rows, places + 1], places)
        for node in range(leaves - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        open_rows = np.flatnonzero(tree[:, 1] != self.NONE)
        while len(open_rows):
            key = tree[open_rows, 1]
            left = key & 63
            right = after[open_rows, left]
            made = self.made[key >> 6]
            follow = after[open_rows, right]
            symbols[open_rows, left], symbols[open_rows, right] = made, -1
            after[open_rows, left] = follow
            before[open_rows, follow] = left
            back = before[open_rows, left]
            tree[open_rows, leaves + right] = self.NONE
            tree[open_rows, leaves + left] = self.keys(made, symbols[open_rows, follow], left)
            has = back >= 0
            rows_back, back = open_rows[has], back[has]
            tree[rows_back, leaves + back] = self.keys(symbols[rows_back, back], made[has], back)
            at = np.concatenate([open_rows, open_rows, rows_back])
            nodes = np.concatenate([right, left, back]) + leaves
            while nodes[0] > 1:
                nodes >>= 1
                tree[at, nodes] = np.minimum(tree[at, 2 * nodes], tree[at, 2 * nodes + 1])
            open_rows = open_rows[tree[open_rows, 1] != self.NONE]
        kept = symbols[:, :leaves]
        return [tuple(x for x in row[:size] if x >= 0) for row, size in zip(kept.tolist(), sizes.tolist(), strict=True)]


def byte_letters() -> dict[int, str]:
    """The printable letter that such vocabularies write for each byte: itself where it can be seen, the others in
    turn from code point 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (byte for byte in range(256) if byte not in seen)
    return {byte: chr(byte) for byte in seen} | {byte: chr(256 + k) for k, byte in enumerate(hidden)}


class Codec:
    """Encoder and decoder for the text of a byte-level tokenizer file."""

    #: How such a file cuts texts when it says no more than ``use_regex``: a fixed value.
    CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, text: str, remember: int = REMEMBERED):
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(text)
        cut = spec["pre_tokenizer"]
        if spec["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError("a byte-level vocabulary without normalizer or prefix space is needed")
        vocab = spec["model"]["vocab"]
        bytes_of = {letter: byte for byte, letter in byte_letters().items()}
        self.first = [vocab[letter] for _, letter in sorted(byte_letters().items())]
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left], vocab[right]] = rank, vocab[left + right]
        self.bytes = [b""] * (1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]))
        for token, number in vocab.items():
            self.bytes[number] = bytes(bytes_of[letter] for letter in token)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for content, number in self.added.items():
            self.bytes[number] = content.encode()
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if self.added else None
        self.numbers = [str(number) for number in range(len(self.bytes))]
        self.cut = regex.compile(self.CUT).findall
        # Letters are those of the Unicode tables at hand. Code points that these tables and the tokenizer's could class
        # differently, the unassigned ones, are left to the file's own cutting rule.
        self.own_cut = Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []})).pre_tokenizer
        self.bytes_of = bytes_of
        self.known = regex.compile(r"[\x00-ԯ]*").fullmatch
        self.piece = Remember(lambda piece: self.said(tuple(merge([self.first[byte] for byte in piece.encode()], self.ranks))), remember)
        self.trees = ManyTrees(self.first, self.ranks)
        self.opening = Remember(lambda word: self.written(word), remember // 5)
        self.spaced = Remember(lambda word: self.written(word, " "), remember)

    def cut_up(self, text: str) -> list[str]:
        if not self.known(text):
            import unicodedata

            if any(unicodedata.category(letter) == "Cn" for letter in set(text)):
                said = self.own_cut.pre_tokenize_str(text)
                return [bytes(self.bytes_of[letter] for letter in piece).decode() for piece, _ in said]
        return self.cut(text)

    def said(self, ids: tuple[int, ...]) -> tuple[int, str, bytes]:
        """What is remembered of ids: how many, written out, and their bytes."""
        return len(ids), ",".join(map(self.numbers.__getitem__, ids)), b"".join(map(self.bytes.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        got = self.piece.__getitem__
        parts = self.split_added(text) if self.split_added and any(x in text for x in self.added) else [text]
        ids: list[int] = []
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(self.added[part])
            elif part:
                for piece in self.cut_up(part):
                    ids += map(int, got(piece)[1].split(","))
        return ids

    def learn(self, texts: list[str]) -> None:
        """Merge the short pieces of these texts that aren't remembered yet, all at once."""
        if not self.trees.usable:
            return
        words = set(chain.from_iterable(text.split(" ")[1:] for text in texts))
        known, older = self.spaced, self.spaced.older
        words = [word for word in words if word not in known and word not in older and len(word) < 64 and self.apart(word)]
        cuts = [self.cut_up(f" {word}") for word in words]
        known, older = self.piece, self.piece.older
        by_size: dict[int, list[str]] = {16: [], 32: []}
        for piece in set(chain.from_iterable(cuts)):
            if piece not in known and piece not in older and (size := len(piece.encode())) <= 32:
                by_size[16 if size <= 16 else 32].append(piece)
        fresh: dict[str, tuple] = {}
        for leaves, found in by_size.items():
            for start in range(0, len(found), 3_000):
                part = found[start : start + 3_000]
                fresh.update(zip(part, map(self.said, self.trees.merge([x.encode() for x in part], leaves)), strict=True))
        for piece, said in fresh.items():
            self.piece.put(piece, said)
        for word, cut in zip(words, cuts, strict=True):
            self.spaced.put(word, self.together([fresh.get(piece) or self.piece[piece] for piece in cut]))

    @staticmethod
    def apart(word: str) -> bool:
        """Whether other white space than single spaces leaves a word alone."""
        return bool(word) and not word[0].isspace() and not word[-1].isspace()

    @staticmethod
    def together(said: list[tuple]) -> tuple:
        if len(said) == 1:
            return said[0]
        return sum(x[0] for x in said), ",".join([x[1] for x in said]), b"".join([x[2] for x in said])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def written(self, word: str, space: str = "") -> tuple | None:
        """Number of ids, ids and bytes of what stands between two single spaces, with the one before it; None if other
        white space touches them. The rule never cuts behind such a space and always before it."""
        return self.together([self.piece[piece] for piece in self.cut_up(space + word)]) if self.apart(word) else None

    def digest(self, text: str) -> tuple[int, str, str]:
        opening, *words = text.split(" ")
        said = None
        if not any(x in text for x in self.added) and (first := self.opening[opening]):
            said = [first, *map(self.spaced.__getitem__, words)]
        if said and None not in said:
            many, joined = sum([x[0] for x in said]), ",".join([x[1] for x in said])
            back = b"".join([x[2] for x in said]).decode("utf-8", "replace")
        else:
            ids = self.encode(text)
            many, joined, back = len(ids), ",".join(map(self.numbers.__getitem__, ids)), self.decode(ids)
        return many, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        self.learn(texts)
        return list(map(self.digest, texts))


def vocabulary(path: str) -> str:
    """The text of a tokenizer file; its size is that of its vocabulary, a few MB, whatever the corpus."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(text: Column, spec: str) -> Column:
    """Token ids of each text, as array<int>. ``spec``: the text of a tokenizer file (``vocabulary``). Null: empty."""

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(spec)
        for texts in batches:
            yield pd.Series(in_pieces(texts, lambda held: [codec.encode(x) for x in held]), dtype=object)

    return encoded(text)


def decode(ids: Column, spec: str) -> Column:
    """The text of token ids; special tokens are written out. Null: empty."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(spec)
        for rows in batches:
            yield pd.Series([codec.decode(list(x)) if x is not None else "" for x in rows], dtype=object)

    return decoded(ids)


def round_trip(text: Column, spec: str, remember: int = REMEMBERED) -> Column:
    """Struct of token count and SHA-256 of the ids (decimal, joined by commas) and of the text decoded from them."""

    @F.pandas_udf(SCHEMA)
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(spec, remember)
        for texts in batches:
            rows = in_pieces(texts, codec.digests, PIECE)
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        del codec
        give_back()

    return digests(text)


def tokenized(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", remember: int = REMEMBERED) -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each row, repeated rows and null keys included.

    A null text is an empty one: no tokens. ``remember`` bounds a task's memory, not its results. Other columns of ``docs`` are left out, whatever their names.
    """
    coded = docs.select(F.col(key), round_trip(F.col(text), vocabulary(path), remember).alias("_coded"))
    return coded.select(key, "_coded.*")
