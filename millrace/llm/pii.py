"""Personal data: patterns, and a skip-chain conditional random field that carries their evidence through a document.

Base spans follow fixed patterns and checks. The field labels words that hold a digit or an at sign with a kind of
personal data or none. It learns from base spans: what such words look like, what stands beside them, which kinds follow
each other, and how far repeated or similar words of a document (equal digits, or equal but for case and marks) share
their kind, however far apart. Loopy messages over chain and skip links then give each word's chances; words that are
personal data for the field and in no base span are added, base spans stay.

Other words are given as "none", so they cut the chain: only words with a digit or an at sign are nodes, and a
document's repeated words are linked one to the next, so links grow with the words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import pieces

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is none of them.
LABELS = len(KINDS) + 1
#: Documents to learn from: the first by a hash of their key. All documents are searched.
SAMPLE = 6000
ROUNDS = 12
#: Chance from which a word is added.
SURE = 0.9
#: How far linked words are taken to share their label before anything is learned.
SHARED = 1.0
#: Fewer words of a kind than this teach nothing.
LEAST = 5

# The patterns of the base spans. Possessive runs, and starts only where a run starts, give the same
# matches as the plain patterns without trying every start of a long run.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MAIL_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
DIGIT = re.compile(r"[0-9]")
HOLDS = re.compile(r"[0-9@]")
WORD = re.compile(r"\S+")
EDGES = ".,;:!?\"'()[]{}<>|*#$%&"


def luhn(digits: str) -> bool:
    """The check of card numbers: every second digit from the right doubled, its digits summed; all divisible by ten."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return (odd + even) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: a name runs back from an at sign as far as its letters go, but not into the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in MAIL_NAME:
            begin -= 1
        if begin < at and (host := MAIL_HOST.match(text, at + 1)):
            yield begin, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of its kind, end) of the fixed patterns, in the order of results; offsets in code points."""
    found = [(start, 0, end) for start, end in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for match in IP.finditer(text):
            parts = [part.lstrip("0") or "0" for part in match[0].split(".")]
            if all(len(part) <= 3 and int(part) <= 255 for part in parts):
                found.append((match.start(), 1, match.end()))
        for match in CARD.finditer(text):
            digits = match[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((match.start(), 2, match.end()))
        if "+" in text:
            for match in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, match[0])) <= 15:
                    found.append((match.start(), 3, match.end()))
    return sorted(found)


def form(word: str) -> str:
    """Letters as a, digits as 9, other characters as they are; runs with their length up to 4."""
    plain = re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", word))
    return re.sub(r"(.)\1*", lambda run: run[1] + str(min(4, len(run[0]))), plain[:200])


def features(word: str, before: str, after: str) -> list[str]:
    """What the field sees of a word and of the words beside it."""
    digits = "".join(c for c in word if c.isascii() and c.isdigit())
    whole = form(word)
    out = [f"form {whole}", f"start {whole[:4]}", f"end {whole[-4:]}", f"digits {min(20, len(digits))}", f"at {word.count('@')}", f"dots {min(4, word.count('.'))}"]
    out += [f"length {min(30, len(word)) // 2}", f"before {form(before)[:6]}", f"after {form(after)[:6]}", "always"]
    if 12 <= len(digits) <= 19:
        out.append(f"luhn {luhn(digits)}")
    return out


def alike(word: str) -> str:
    """What repeated or similar words have in common: their last seven digits, or else letters and digits in lower case."""
    digits = "".join(c for c in word if c.isascii() and c.isdigit())
    if "@" not in word and len(digits) >= 7:
        return digits[-7:]
    return "".join(c for c in word.lower() if c.isalnum() or c == "@")


@dataclass
class Graph:
    """Nodes of some documents: words with a digit or an at sign, and their links."""

    spans: list[tuple[int, int, int]] = field(default_factory=list)  # document, start, end without marks at the edges
    seen: list[list[str]] = field(default_factory=list)
    base: list[int] = field(default_factory=list)  # label by base spans; -1 if the word is in none, but touches one
    alone: list[tuple[bool, bool]] = field(default_factory=list)  # whether a plain word stands before, and after
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)

    def add(self, document: int, text: str, base: list[tuple[int, int, int]]) -> None:
        last_like: dict[str, int] = {}
        offset, at = 0, 0
        for line in text.split("\n"):
            if HOLDS.search(line):
                words = [(m.start(), m.end()) for m in WORD.finditer(line)]
                texts = [line[a:b] for a, b in words]
                previous = None
                for k, ((begin, end), raw) in enumerate(zip(words, texts, strict=True)):
                    if not HOLDS.search(raw):
                        previous = None
                        continue
                    core = raw.strip(EDGES) or raw
                    start = offset + begin + raw.find(core)
                    stop = start + len(core)
                    while at < len(base) and base[at][2] <= start:
                        at += 1
                    label = 0
                    for one in base[at : at + 8]:
                        if one[0] >= stop:
                            break
                        label = one[1] + 1 if one[0] <= start + 1 and stop - 1 <= one[2] else -1
                        if label > 0:
                            break
                    node = len(self.spans)
                    self.spans.append((document, start, stop))
                    self.seen.append(features(core, texts[k - 1] if k else "", texts[k + 1] if k + 1 < len(texts) else ""))
                    self.base.append(label)
                    plain_after = k + 1 < len(texts) and not HOLDS.search(texts[k + 1])
                    self.alone.append((k > 0 and previous is None, plain_after))
                    if previous is not None:
                        self.chain.append((previous, node))
                    previous = node
                    if len(like := alike(core)) >= 4:
                        if like in last_like and (last_like[like], node) not in self.chain[-1:]:
                            self.skip.append((last_like[like], node))
                        last_like[like] = node
            offset += len(line) + 1


@dataclass
class Field:
    """Weights of features by label, of labels that follow each other, and of labels of linked words."""

    numbers: dict[str, int] = field(default_factory=dict)
    unary: np.ndarray = field(default_factory=lambda: np.zeros((0, LABELS)))
    follow: np.ndarray = field(default_factory=lambda: np.zeros((LABELS, LABELS)))
    share: np.ndarray = field(default_factory=lambda: SHARED * np.eye(LABELS))

    def potentials(self, graph: Graph) -> np.ndarray:
        got = self.numbers.get
        out = np.zeros((len(graph.seen), LABELS))
        for k, names in enumerate(graph.seen):
            known = [n for n in map(got, names) if n is not None]
            if known:
                out[k] = self.unary[known].sum(axis=0)
        before, after = np.array(graph.alone, bool).reshape(-1, 2).T
        out += before[:, None] * self.follow[0] + after[:, None] * self.follow[:, 0]
        return out

    def chances(self, graph: Graph) -> np.ndarray:
        """Marginals by loopy messages, all links of all documents at a time."""
        own = self.potentials(graph)
        links = np.array(graph.chain + graph.skip, np.int64).reshape(-1, 2)
        if len(links):
            chained = len(graph.chain)
            pots = np.concatenate([np.tile(self.follow, (chained, 1, 1)), np.tile(self.share, (len(links) - chained, 1, 1))])
            source = np.concatenate([links[:, 0], links[:, 1]])
            target = np.concatenate([links[:, 1], links[:, 0]])
            pots = np.concatenate([pots, pots.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
            sent = np.zeros((len(source), LABELS))
            for _ in range(ROUNDS):
                total = own.copy()
                np.add.at(total, target, sent)
                given = total[source] - sent[back]
                new = _logsum(given[:, :, None] + pots, 1)
                new -= new.max(axis=1, keepdims=True)
                moved = np.abs(new - sent).max()
                sent = 0.5 * sent + 0.5 * new
                if moved < 1e-3:
                    break
            np.add.at(own, target, sent)
        own -= own.max(axis=1, keepdims=True) if len(own) else 0
        odds = np.exp(own)
        return odds / odds.sum(axis=1, keepdims=True) if len(own) else odds


def _logsum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.log(np.exp(values - top).sum(axis=axis)) + np.squeeze(top, axis)


def train(texts: list[str], rounds: int = 80) -> Field:
    """Fit by pseudo-likelihood: each word's label given its neighbours' and its linked words'. Words that a base span
    only touches teach nothing."""
    graph, model = Graph(), Field()
    for k, text in enumerate(texts):
        graph.add(k, text, base_spans(text))
    truth = np.array(graph.base, np.int64)
    if (truth > 0).sum() < LEAST:
        return model
    for names in graph.seen:
        for name in names:
            model.numbers.setdefault(name, len(model.numbers))
    owner = np.repeat(np.arange(len(graph.seen)), [len(x) for x in graph.seen])
    used = np.array([model.numbers[name] for names in graph.seen for name in names], np.int64)
    model.unary = np.zeros((len(model.numbers), LABELS))
    weights = (truth >= 0).astype(float)
    known = np.maximum(truth, 0)
    target = np.eye(LABELS)[known]
    chain, skip = (np.array(x, np.int64).reshape(-1, 2) for x in (graph.chain, graph.skip))
    before, after = np.array(graph.alone, bool).reshape(-1, 2).T
    speeds = [np.full_like(x, 1e-3) for x in (model.unary, model.follow, model.share)]
    for _ in range(rounds):
        score = np.zeros((len(truth), LABELS))
        np.add.at(score, owner, model.unary[used])
        score += before[:, None] * model.follow[0] + after[:, None] * model.follow[:, 0]
        np.add.at(score, chain[:, 1], model.follow[known[chain[:, 0]]])
        np.add.at(score, chain[:, 0], model.follow[:, known[chain[:, 1]]].T)
        np.add.at(score, skip[:, 1], model.share[known[skip[:, 0]]])
        np.add.at(score, skip[:, 0], model.share[known[skip[:, 1]]])
        score -= score.max(axis=1, keepdims=True)
        odds = np.exp(score)
        gap = (target - odds / odds.sum(axis=1, keepdims=True)) * weights[:, None]
        unary, follow, share = np.zeros_like(model.unary), np.zeros_like(model.follow), np.zeros_like(model.share)
        np.add.at(unary, used, gap[owner])
        follow[0] += gap[before].sum(axis=0)
        follow[:, 0] += gap[after].sum(axis=0)
        np.add.at(follow, known[chain[:, 0]], gap[chain[:, 1]])
        np.add.at(follow.T, known[chain[:, 1]], gap[chain[:, 0]])
        np.add.at(share, known[skip[:, 0]], gap[skip[:, 1]])
        np.add.at(share, known[skip[:, 1]], gap[skip[:, 0]])
        share = (share + share.T) / 2
        prior = (0.0, 0.0, SHARED * np.eye(LABELS))
        for part, slope, speed, usual in zip((model.unary, model.follow, model.share), (unary, follow, share), speeds, prior, strict=True):
            slope = slope - 0.05 * (part - usual)
            speed += slope * slope
            part += 0.3 * slope / np.sqrt(speed)
    model.share = (model.share + model.share.T) / 2
    return model


def spans_of(texts: list[str], model: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and added spans of each text."""
    graph = Graph()
    base = [base_spans(text) if HOLDS.search(text) else [] for text in texts]
    if not len(model.numbers):
        return [(own, []) for own in base]
    for k, (text, own) in enumerate(zip(texts, base, strict=True)):
        if HOLDS.search(text):
            graph.add(k, text, own)
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if graph.spans:
        chances = model.chances(graph)
        best = chances[:, 1:].argmax(axis=1)
        follows = {second: first for first, second in graph.chain}
        joined: dict[int, int] = {}
        for node in np.flatnonzero((chances[:, 1:].max(axis=1) >= SURE) & (np.array(graph.base) == 0)).tolist():
            document, start, end = graph.spans[node]
            kind = int(best[node])
            before = follows.get(node)
            if before in joined and added[document][joined[before]][1] == kind:  # neighbours of a kind are one span
                added[document][joined[before]] = (added[document][joined[before]][0], kind, end)
                joined[node] = joined[before]
            else:
                joined[node] = len(added[document])
                added[document].append((start, kind, end))
    return list(zip(base, added, strict=True))


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def personal_data(text: Column, model: Field) -> Column:
    """Struct of the base spans' counts and digest, and all spans, of each text; a null is an empty text."""

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for held in pieces(texts):
                for base, added in spans_of(held, model):
                    many = [sum(1 for span in base if span[1] == kind) for kind in range(len(KINDS))]
                    rows.append((*many, hashlib.sha256(written(base).encode()).hexdigest(), written(base + added)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return found(text)


def sample(docs: DataFrame, text: str, key: str, size: int = SAMPLE) -> list[str]:
    """The texts of the ``size`` keys that come first by a hash; only keys are ordered, and joined to their texts by
    broadcast, being bounded."""
    ids = [row["_id"] for row in docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_id")).distinct().orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(size).collect()]
    if not ids:
        return []
    small = docs.sparkSession.createDataFrame([(x,) for x in ids], f"_id {docs.schema[key].dataType.simpleString()}")
    rows = docs.where(F.col(text).rlike("[0-9@]")).select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(small), "_id")
    return sorted(row["_text"] for row in rows.select("_text").collect())


def found(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and what ``personal_data`` finds in each row, by a field fitted to a sample of the same documents."""
    model = train(sample(docs, text, key))
    return docs.select(F.col(key), personal_data(F.col(text), model).alias("_found")).select(key, "_found.*")
