"""Personal data: base spans against the plain patterns, messages against all labellings, and words added by links."""

import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pii

SF = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and plain_luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1@.+-_ ()59%é²\n", max_size=40))
def test_any_text(text):
    assert pii.base_spans(text) == plain_spans(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "@", ".", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", "255", "256", "é", " ", "-", "x.y", "00"]), max_size=12))
def test_pieces_side_by_side(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_take_no_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 100_000 + "@"):
        pii.base_spans(text)


def test_query(spark):
    import hashlib

    from millrace.llm.queries import op5_pii

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op5_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    some = 0
    for r in rows:
        base = plain_spans(texts[r["doc_id"]] or "")
        some += len(base)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in base) for k in range(4)]
        line = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(line).encode()).hexdigest()
        assert set(line) <= set(r["spans"].split(","))
    assert some


def test_messages_against_all_labellings():
    """On a tree loopy messages are exact."""
    rng = np.random.default_rng(0)
    model = pii.Field({"a": 0, "b": 1}, rng.normal(size=(2, pii.LABELS)), rng.normal(size=(pii.LABELS,) * 2), np.zeros((pii.LABELS,) * 2))
    half = rng.normal(size=(pii.LABELS,) * 2)
    model.share = half + half.T
    graph = pii.Graph(
        spans=[(0, k, k + 1) for k in range(4)], seen=[["a"], ["b"], ["a", "b"], []], base=[0] * 4,
        alone=[(True, False), (False, True), (True, True), (False, False)], chain=[(0, 1)], skip=[(1, 2), (2, 3)],
    )
    own = model.potentials(graph)
    expected = np.zeros((4, pii.LABELS))
    for labels in itertools.product(range(pii.LABELS), repeat=4):
        score = sum(own[k, x] for k, x in enumerate(labels)) + model.follow[labels[0], labels[1]]
        score += model.share[labels[1], labels[2]] + model.share[labels[2], labels[3]]
        for k, x in enumerate(labels):
            expected[k, x] += np.exp(score)
    expected /= expected.sum(axis=1, keepdims=True)
    assert np.abs(model.chances(graph) - expected).max() < 0.02


def training():
    texts = []
    for k in range(200):
        texts.append(f"call me on +1 (555) {100 + k}-{4000 + k} or write to name{k}@mail{k % 7}.example.com today")
        texts.append(f"the host 10.{k}.3.{k % 200} answered and order {k} of {k * 37} went out at 4.0 yesterday")
        texts.append(f"first +1 (555) {100 + k}-{5000 + k} then\nonce more +1 (555) {100 + k}-{5000 + k} and order {k * 37} twice, {k * 37}")
    return texts


def test_repeated_words_share_their_kind():
    model = pii.train(training())
    text = "call me on +1 (555) 123-4567 today\nthe order 17 went out\nagain call me on 123-4567 today"
    (base, added), (_, plain) = pii.spans_of([text, "the order 17 of 629 went out at 4.0 yesterday"], model)
    assert [k for _, k, _ in base] == [3] and not plain
    assert [(text[a:b], k) for a, k, b in added] == [("123-4567", 3)]
    assert model.share[4, 4] > model.share[4, 0]


def test_nulls_empties_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(1, None, 5), (2, "", 5), (None, "a@b.cd", 5), (3, "x" * 100_000 + " 1.2.3.4", 5), (3, "a@b.cd", 5), (3, "a@b.cd", 5)],
        "doc_id long, text string, spans int",
    )
    rows = sorted(((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["spans"]) for r in pii.found(docs).collect()))
    assert rows == [(0, 1, 0, "email:0:6"), (1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 1, "ip:100001:100008"), (3, 1, 0, "email:0:6"), (3, 1, 0, "email:0:6")]
    assert pii.found(docs.limit(0)).collect() == []
