import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import queries
from millrace.llm import suffixtree as lm

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = ("end",)


def tokens_of(text):
    return [*WORDS.findall((text or "").translate(LOWER)), END]


def held(key, fold=(5, 1)):
    return key is not None and zlib.crc32(str(key).encode()) % fold[0] == fold[1]


def plainly(rows, depth, least=lm.DIVERGENCE):
    """The tree with dictionaries: all contexts in one place, by the definitions."""
    each = [(key, tokens_of(text)) for key, text in rows]
    unigrams, after = Counter(), defaultdict(Counter)
    for key, tokens in each:
        if not held(key):
            unigrams.update(tokens)
            for i in range(len(tokens)):
                for k in range(1, min(depth, i) + 1):
                    after[tuple(tokens[i - k : i])][tokens[i]] += 1
    n, v = sum(unigrams.values()), len(unigrams)

    def root(w):
        return (unigrams[w] + 0.5) / (n + 0.5 * (v + 1))

    def chance(w, state):
        if not state:
            return root(w)
        seen = after[state]
        return (seen[w] + len(seen) * chance(w, state[1:])) / (sum(seen.values()) + len(seen))

    states = set()
    for context in sorted(after, key=len):
        if len(context) > 1 and context[1:] not in states:
            continue
        seen = after[context]
        total, kinds = sum(seen.values()), len(seen)
        if total < 2:
            continue
        gain = 0.0
        for w, c in seen.items():
            if c > 1:
                gain += c * math.log((c - 1) / (total + kinds - 1) / chance(w, context[1:]))
            else:
                gain += math.log(max(kinds - 1, 1) / max(total + kinds - 2, 1))
        if gain >= least:
            states.add(context)
    out = []
    for key, tokens in each:
        score = 0.0
        for i, w in enumerate(tokens):
            state = ()
            while len(state) < min(depth, i) and tuple(tokens[i - len(state) - 1 : i]) in states:
                state = tuple(tokens[i - len(state) - 1 : i])
            score += math.log10(chance(w, state))
        out.append((key, held(key), len(tokens), sum(unigrams[w] > 0 for w in tokens), n, sum(math.log10(root(w)) for w in tokens), score))
    return out, states, chance, unigrams


def corpus(seed=3, documents=150):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Élan", "extraordinarily-long-word", "ABC", "abc", "漢字", "x" * 40, "a\0", "a"]
    phrases = [[rng.choice(words) for _ in range(rng.randrange(3, 9))] for _ in range(12)]
    # What follows depends on three words, on two, or on four.
    forks = [[f"w{a}", "w2", "w3", f"w{a + 20}"] for a in (5, 9, 11, 15)] * 2 + [[f"w{a}", "w2", "w3", "w4", f"w{a + 20}"] for a in (5, 9)] * 2
    out = []
    for _ in range(documents):
        parts = []
        while len(parts) < rng.randrange(1, 60):
            parts += rng.choice([*phrases, *forks]) if rng.random() < 0.4 else [rng.choice(words)]
        out.append(rng.choice([" ", "\n", "\t ", "\x0b"]).join(parts) + rng.choice(["", " ", "\n"]))
    return out


def close(got, want):
    assert len(got) == len(want)
    order = lambda row: (str(row[0]), *map(str, row[1:5]), round(row[5], 6), round(row[6], 6))
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-11, abs_tol=1e-12) and math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-12)


ODD = [(None, "w1 w2 w3"), (None, None), (7001, None), (7002, ""), (7003, " \n\t "), (7004, "w1 " * 3000), (7005, "never seen this"), (7005, "never seen this"), (7005, "w1")]


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_against_dictionaries(spark, depth):
    rows = [*enumerate(corpus()), *ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, states, _, _ = plainly(rows, depth)
    assert max(map(len, states)) == min(depth, 3)  # the tree ends where the text says no more
    close(lm.scored(docs, depth=depth).collect(), want)


def test_many_small_blocks_and_slices_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 200)
    monkeypatch.setattr(lm, "SLICE", 300)
    rows = [*enumerate(corpus(8)), *ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    close(lm.scored(docs).collect(), plainly(rows, 3)[0])


def test_chances_of_every_state_sum_to_one():
    rows = list(enumerate(corpus(5, 60)))
    _, states, chance, unigrams = plainly(rows, 3)
    for state in [(), *sorted(states, key=str)[:40]]:
        assert math.isclose(sum(chance(w, state) for w in [*unigrams, "unknown"]), 1.0, rel_tol=1e-9)


def test_repeated_passages_score_far_above_single_words(spark):
    rng = random.Random(1)
    passage = " ".join(f"p{rng.randrange(400)}" for _ in range(60))
    rows = [(k, text + " " + passage if k % 3 == 0 else text) for k, text in enumerate(corpus(9, 90))]
    out = {r.doc_id: r for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    with_it = [k for k in out if out[k].held_out and k % 3 == 0]
    assert with_it
    for k in with_it:
        assert out[k].score > out[k].base_score + 60


def test_hashes_are_those_of_the_words(spark):
    texts = ["", " ", "A", "b  A\x0bé", "漢字\nx" + "y" * 20, "abcdefgh abcdefghi ABCDEFGH", "\0 \0\0", "a", "[ @ z{", "end"]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    hashes, sizes = lm.token_hashes(np.frombuffer(b"".join(data), np.uint8), offsets)
    words = [w for t in texts for w in tokens_of(t)]
    assert sizes.tolist() == [len(tokens_of(t)) for t in texts] and len(hashes) == len(words)
    assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))


@pytest.mark.parametrize("kind", [np.uint64, np.int32, np.float64, np.uint32])
def test_squeezed_numbers_come_back(kind):
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 30, 500).astype(kind))
    for some in (values, values[:0], values[:1]):
        assert lm.expanded(lm.squeezed(some)).tolist() == some.tolist()
        assert lm.expanded_rising(lm.squeezed_rising(some)).tolist() == some.tolist()


def test_odd_tables(spark):
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    empty = lm.scored(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == [] and empty.columns == columns
    key = next(k for k in range(100) if held(k))
    alone = lm.scored(spark.createDataFrame([(key, "a b a")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in alone] == [(key, True, 4, 0, 0, 0.0, 0.0)]
    odd = spark.createDataFrame([("k", "a b a b", 1, 2, True)], "doc_id string, text string, block int, ids int, held boolean")
    close(lm.scored(odd).collect(), plainly([("k", "a b a b")], 3)[0])
    with pytest.raises(ValueError):
        lm.scored(odd, depth=0)


def test_the_query_over_its_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    close(queries.op12_suffix_tree(spark, sf).collect(), plainly(rows, lm.DEPTH)[0])
