"""Toxicity, language and quality: their inner steps against plain forms, and accuracy on held-out rows."""

import itertools
import random
import zlib

import numpy as np
import pytest

from millrace.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, score double"


def fold(key, folds):
    return zlib.crc32(str(key).encode()) % folds


def test_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    into, stay, back = moves = np.array([-0.7, 1.2, -0.3])
    edge = {(0, 0): 0.0, (0, 1): into, (1, 1): stay, (1, 0): back}
    sizes = [5, 1, 7, 3]
    unary = rng.normal(size=sum(sizes)) * 2
    starts = np.zeros(len(unary), bool)
    starts[[0, 5, 6, 13]] = True
    expected, at = [], 0
    for size in sizes:
        own, total = np.zeros(size), 0.0
        for path in itertools.product((0, 1), repeat=size):
            score = into * path[0] + sum(edge[pair] for pair in itertools.pairwise(path)) + (unary[at : at + size] * path).sum()
            own += np.exp(score) * np.array(path)
            total += np.exp(score)
        expected.append(own / total)
        at += size
    assert np.allclose(toxicity.marginals(unary, starts, moves), np.concatenate(expected))


def test_marginals_don_t_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    unary, starts, moves = rng.normal(size=1000) * 3, rng.random(1000) < 0.01, np.array([-1.0, 2.0, 0.5])
    starts[0] = True
    whole = toxicity.marginals(unary, starts, moves)
    monkeypatch.setattr(toxicity, "WIDE", 7)
    assert np.allclose(toxicity.marginals(unary, starts, moves), whole)


def labelled(spark, label):
    rows = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    return {r["doc_id"]: r[label] for r in rows.select("doc_id", label).collect()}


def test_toxicity_on_held_out_rows(spark):
    from millrace.llm.queries import op10_toxicity

    rows = {r["doc_id"]: r for r in op10_toxicity(spark, SF).collect()}
    truth = labelled(spark, "toxic")
    assert len(rows) == 10_000
    assert all(r["held_out"] == (fold(k, 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for k, r in rows.items())
    held = [(rows[k]["predicted"], t) for k, t in truth.items() if fold(k, 4) == 2]
    hits = sum(p and t for p, t in held)
    assert hits / sum(p for p, _ in held) > 0.95 and hits / sum(t for _, t in held) > 0.7


def toxic_rows(spark, many=120):
    rng = random.Random(3)
    words = [f"plain{k}" for k in range(300)]
    rows, labels = [], []
    for key in range(many):
        text = [rng.choice(words) for _ in range(40)]
        if key % 4 == 0:
            text[rng.randrange(40)] = rng.choice(["Nastyone", "nastytwo", "nasty"])
        rows.append((key, " ".join(text), "en", 0.0))
        labels.append((key, int(key % 4 == 0), 1))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_spans(spark):
    docs, labels = toxic_rows(spark)
    model = toxicity.fit(docs, labels)
    text = "Some plain1 NASTY, nasty thing"
    frame = spark.createDataFrame([(1, text), (2, "plain1 plain2"), (3, None), (4, "")], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in frame.select("doc_id", toxicity.toxic_spans(frame["text"], model).alias("spans")).collect()}
    assert [text[s["start"] : s["end"]] for s in spans[1]] == ["NASTY, nasty"]
    assert not spans[2] and not spans[3] and not spans[4]
    long = "plain1 " * 30_000
    more = spark.createDataFrame([(1001, text), (1001, text), (None, None), (1002, ""), (1003, long + "Nasty plain2 nasty")], "doc_id long, text string")
    more = docs.select("doc_id", "text").union(more)
    rows = toxicity.scored(more.withColumn("spans", more["text"]).withColumn("_judged", more["text"]), labels).collect()
    assert len(rows) == 125 and all(bool(r["spans"]) == (r["doc_id"] in (1001, 1003) or r["doc_id"] in range(0, 120, 4)) for r in rows)
    by_model = toxicity.Remember(model.log_odds)
    for value, wanted in ((text, ["NASTY, nasty"]), (long + "Nasty plain2 nasty", ["Nasty", "nasty"])):
        chances = model.of_documents([value], by_model)[0][0]
        words = [(m.start(), m.end()) for m in toxicity.WORD.finditer(value)]
        inside = [k for k, p in enumerate(chances) if p >= 0.5]
        runs = [(words[k][0], next(words[e][1] for e in range(k, len(words)) if e + 1 not in inside)) for k in inside if k - 1 not in inside]
        assert [(s["start"], s["end"]) for s in toxicity.runs_of(value, chances, 0.5)] == runs and [value[b:e] for b, e in runs] == wanted
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    kept = {r["doc_id"] for r in toxicity.without_toxic(docs, labels).collect()}
    assert kept == {k for k in range(120) if k % 4}


@pytest.mark.parametrize("operator", [toxicity.scored, quality.scored])
def test_scores_without_much_to_learn_from(spark, operator):
    docs = spark.createDataFrame([(1, None, None, 1.0), (2, "", "en", 2.0), (None, "a b", "en", 3.0), (4, "a " * 50_000, "en", 4.0), (4, "a b", "en", 4.0)], DOCS)
    label = "toxic" if operator is toxicity.scored else "quality"
    for labels in ([], [(1, 1), (2, None), (None, 0)], [(4, 1), (4, 0)], [(2, 0), (4, 0)], [(2, 1), (4, 0), (5, 1)]):
        rows = operator(docs, spark.createDataFrame(labels, f"doc_id long, {label} int")).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert operator(docs.limit(0), spark.createDataFrame([(1, 1)], f"doc_id long, {label} int")).collect() == []


def test_quality_on_held_out_rows(spark):
    from millrace.llm.queries import op9_quality

    rows = {r["doc_id"]: r for r in op9_quality(spark, SF).collect()}
    truth = labelled(spark, "quality")
    assert len(rows) == 10_000
    assert all(r["held_out"] == (fold(k, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for k, r in rows.items())
    held = [(rows[k]["score"], rows[k]["predicted"], t) for k, t in truth.items() if fold(k, 5) == 0]
    assert np.mean([p == t for _, p, t in held]) > 0.93
    good, bad = [s for s, _, t in held if t], [s for s, _, t in held if not t]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_neighbours_against_plain_cosines():
    rng = np.random.default_rng(4)
    model = quality.train(["a b c", "d e f!!", "g h i", "j j j j", "k l M N"] * 10, np.array([1, 0, 1, 0, 1] * 10), 0.7)
    rows = quality.counts(["a b x", "j j k", "", "d f!!"], quality.Remember(quality.terms_of)) + rng.random((4, quality.TERMS)).astype(np.float32) / 500
    place = model.place(rows)
    for one, score in zip(place, model.score(rows, block=3), strict=True):
        near = sorted(((float(one @ v), k) for k, v in enumerate(model.vectors)), reverse=True)[: quality.NEAREST]
        votes = [(max(s, 0) / (1.02 - min(s, 1.0)) * model.weights[k], model.labels[k]) for s, k in near]
        assert score == pytest.approx(sum(v * t for v, t in votes) / sum(v for v, _ in votes), abs=0.02)


def test_language_on_held_out_rows(spark):
    from millrace.llm.queries import op7_language

    rows = {r["doc_id"]: r for r in op7_language(spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == 10_000
    assert all(r["held_out"] == (fold(k, 4) == 2) and 0 <= r["score"] <= 1 for k, r in rows.items())
    held = [rows[k]["lang_pred"] == t for k, t in truth.items() if fold(k, 4) == 2 and t]
    assert np.mean(held) > 0.97


def languages(spark):
    rng = random.Random(6)
    sounds = {"aa": ["bar", "dor", "gan"], "zz": ["kli", "tse", "vux"]}
    made = lambda lang, n: " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(n))
    rows = [(k, made(lang, 60), lang, 0.0) for k, lang in enumerate(["aa", "zz"] * 20)]
    return rows, made


def test_mixtures_and_odd_texts(spark):
    rows, made = languages(spark)
    mixed = made("aa", 60) + " " + made("zz", 30)
    odd = [(100, mixed, None, 0.0), (101, None, "aa", 0.0), (102, "", "aa", 0.0), (103, "12 !?", "aa", 0.0), (None, made("zz", 9), None, 0.0), (104, made("zz", 30_000), None, 0.0)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    found = {r["doc_id"]: (r["lang_pred"], r["langs"], r["score"]) for r in langid.predicted(docs).collect()}
    assert all(found[k][0] == lang for k, _, lang, _ in rows)
    assert found[100][1] == "aa,zz" and found[100][2] == pytest.approx(2 / 3, abs=0.08)
    assert found[101] == found[102] == found[103] == ("und", "", 0.0)
    assert found[None][0] == found[104][0] == "zz" and found[104][1] == "zz"
    assert langid.predicted(docs.limit(0)).collect() == []
    nothing = langid.predicted(docs.where("lang is null")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_expectation_maximisation_climbs():
    words = np.log(np.random.default_rng(5).random((50, 3)))
    starts, place = np.array([0, 20]), np.repeat([0, 1], [20, 30])
    shares, before = np.full((2, 3), 1 / 3), -np.inf
    for _ in range(5):
        shares, likely = langid.Languages.fit(words, starts, place, shares)
        assert (likely >= before - 1e-9).all() and np.allclose(shares.sum(axis=1), 1)
        before = likely
