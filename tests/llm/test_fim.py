import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import fim, queries

LINES = re.compile(r"[^\n]*\n|[^\n]+")


def plainly(key, text, rate=100, turned=50, units="lines"):
    """The same by regular expressions over code points."""
    text = text or ""
    parts = LINES.findall(text) if units == "lines" else list(text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(parts)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < turned:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    alphabet = ["a", "b", "é", "漢", "😀", "\n", "\n", "\r", " ", "<", "P>", "\0", " ", "\x8a", "ઊ"]
    out = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "x<P>y", "<S>", "a\n<M>", "<\nP>\n", "z" * 9 + "\n" + "y" * 17]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    return [*out, "line é\n" * 40_000 + "end", "漢" * 100_000, "same\ntext", "same\ntext"]


@pytest.mark.parametrize("units", fim.UNITS)
def test_against_regular_expressions(spark, units):
    rows = [(k if k != 20 else None, t) for k, t in enumerate(texts())] + [(3, "a\nb\nc"), (3, "a\nb\nc"), (-4, "q\nr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for rate, turned in ((100, 50), (60, 100)):
        out = fim.transformed(docs, rate=rate, turned=turned, units=units)
        out = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        got = sorted((str(r.doc_id), r.text or "", r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out)
        want = sorted((str(k), t or "", *plainly(k, t, rate, turned, units)) for k, t in rows)
        assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in want]
        assert all(r.back == (r.text or "") for r in out)
    assert {r.form for r in out} >= {"plain", "spm"}


def test_selected_marks_against_a_scan():
    rng = np.random.default_rng(3)
    for size in (0, 1, 7, 8, 9, 64, 1000):
        data = rng.choice(np.array([10, 11, 138, 0, 255, 9, 128], np.uint8), size)
        words = fim.as_words(data)
        marks = fim.Marks(fim.newline_marks(words))
        places = np.flatnonzero(data == 10)
        assert marks.select(np.arange(1, len(places) + 1)).tolist() == places.tolist() if len(places) else True
        upto = np.arange(size + 1)
        assert marks.rank(upto).tolist() == [int((data[:k] == 10).sum()) for k in upto]


def test_odd_tables(spark):
    empty = fim.transformed(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    odd = spark.createDataFrame([("k", "a\nb", 1, "mine", 2)], "doc_id string, text string, _body int, form string, N int")
    row = fim.transformed(odd).first()
    assert row["_body"] == 1 and (row["n"], row["form"], row["output"]) == tuple(np.array(plainly("k", "a\nb"), object)[[0, 1, 4]])
    with pytest.raises(ValueError):
        fim.transformed(odd, units="words")


def test_the_query_needs_no_shuffle(spark):
    plan = queries.op13_fim(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
