"""Decontamination: the alignment against the textbook recursion, and planted copies, edited ones included."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import decontam

SF = "/root/testdata/sf0.001"


def plain_score(item, window):
    best, table = 0, np.zeros((len(item) + 1, len(window) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(window, 1):
            step = decontam.MATCH if a == b else decontam.MISMATCH
            table[i, j] = max(0, table[i - 1, j - 1] + step, table[i - 1, j] + decontam.GAP, table[i, j - 1] + decontam.GAP)
            best = max(best, table[i, j])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=12), st.lists(st.integers(0, 5), min_size=1, max_size=20))
def test_alignment(item, window):
    score, first, last = decontam.align(np.array(item), np.array(window))
    assert score == plain_score(item, window)
    if score:
        assert plain_score(item, window[first : last + 1]) == score


def test_query_against_all_pairs(spark):
    from millrace.llm.queries import op1_decontamination

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    numbers = {}
    number = lambda text: np.array([numbers.setdefault(w, len(numbers) + 1) for w in decontam.words_of(text or "")])
    expected = set()
    asked = [(k, number(t)) for k, t in items]
    for key, text in docs:
        words = number(text)
        for item, own in asked:
            if len(words) and np.isin(own, words).mean() >= decontam.LEAST / 2:
                share = decontam.align(own, words)[0] / (decontam.MATCH * len(own))
                if share >= decontam.LEAST:
                    expected.add((key, item, round(share, 9)))
    found = {(r["doc_id"], r["item_id"], round(r["score"], 9)) for r in op1_decontamination(spark, SF).collect()}
    assert found == expected and found


def planted(rng):
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [fresh(30) for _ in range(20)]
    docs = {}
    for k, item in enumerate(items):
        whole = fresh(50) + item + fresh(50)
        changed = list(item)
        for place in rng.sample(range(30), 4):
            changed[place] = "changed"
        cut = [w for n, w in enumerate(item) if n not in (7, 19)]
        docs[100 + k], docs[200 + k], docs[300 + k] = whole, fresh(20) + changed, fresh(10) + cut[:9] + ["added"] + cut[9:] + fresh(400)
        docs[400 + k] = fresh(80)
    return [(k, " ".join(item)) for k, item in enumerate(items)], [(k, " ".join(words)) for k, words in docs.items()]


def test_edited_copies_are_found_and_others_not(spark):
    items, docs = planted(random.Random(1))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert found == {(100 * n + k, k) for n in (1, 2, 3) for k in range(20)}


def test_small_blocks_change_nothing(spark, monkeypatch):
    items, docs = planted(random.Random(2))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    whole = sorted(map(tuple, decontam.contaminated(table, benchmark).collect()))
    monkeypatch.setattr(decontam.blocks, "__defaults__", ("text", "item_id", 100))
    assert len(list(decontam.blocks(benchmark))) > 3
    assert sorted(map(tuple, decontam.contaminated(table, benchmark).collect())) == whole


def test_nulls_empties_short_items_and_clashing_columns(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    benchmark = spark.createDataFrame([(1, "one two three four five six"), (2, None), (None, "x"), (3, ""), (4, "alone"), (1, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, None, 5), (2, "", 5), (None, "one two three four five six", 5), (3, long + " One, two three four FIVE six!", 5), (4, "this is alone", 5), (5, "five six", 5)],
        "doc_id long, text string, item_id int",
    )
    found = sorted(((r["doc_id"] or 0, r["item_id"]) for r in decontam.contaminated(docs, benchmark).collect()))
    assert found == [(0, 1), (0, 1), (3, 1), (3, 1), (4, 4)]
    kept = decontam.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5]
    assert decontam.contaminated(docs, benchmark.limit(0)).collect() == []
    assert decontam.contaminated(docs.limit(0), benchmark).collect() == []
    assert decontam.without_leaks(docs, benchmark.limit(0)).count() == 6


def test_templated_items_are_found_with_the_telling_word_edited(spark):
    """Items that share all but one word, and passages broken up after every second word, whatever the blocks."""
    rng = random.Random(3)
    template = [f"t{k}" for k in range(30)]
    items = [(k, " ".join([*template[:14], f"name{k}", *template[15:]])) for k in range(8)]
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    broken = [word for k in range(0, 30, 2) for word in [*template[k : k + 2], "between"]]
    docs = [(1, " ".join([*fresh(40), *template[:14], "edited", *template[15:], *fresh(40)])), (2, " ".join(fresh(90))), (3, " ".join([*fresh(20), *broken, *fresh(20)]))]
    benchmark, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table, benchmark).collect()}
    assert found == {(key, k) for key in (1, 3) for k in range(8)}
    assert [r["doc_id"] for r in decontam.without_leaks(table, benchmark).collect()] == [2]


def test_common_phrases_are_no_short_items(spark):
    """Clean documents that share a common phrase with a short question stay; the whole question is found."""
    benchmark = spark.createDataFrame([(1, "What is the capital of France?"), (2, "Who wrote it first then"), (3, "How many of these ten common words does it have")], "item_id long, text string")
    docs = [(1, "Lima is the capital of Peru"), (2, "they say he wrote it first"), (3, "so we ask what is the capital of France? and go on"), (4, "how many of these ten common things are there"), (5, "and how many of these ten common words does it have now")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table, benchmark).collect()} == {(3, 1), (5, 3)}
    assert sorted(r["doc_id"] for r in decontam.without_leaks(table, benchmark).collect()) == [1, 2, 4]
