"""Line dedup against a comparison of all lines with all others."""

import random

import pytest

from millrace.llm import linededup

SF = "/root/testdata/sf0.001"


def plain_dedup(rows, similarity=0.8):
    """Text and removed lines of each row: every line with an earlier match goes."""
    first, lines = {}, {}
    for key, text in rows:
        if key is None or text is None:
            continue
        for n, line in enumerate(text.split("\n")):
            words = frozenset(line.encode().lower().split())
            if words:
                first[words] = min(first.get(words, (key, n)), (key, n))
                lines[key, n] = words
    sets = sorted(first, key=lambda s: (len(s), sorted(s)))
    later = set()
    holders = {}
    for k, one in enumerate(sets):
        for word in one:
            holders.setdefault(word, []).append(k)
    for k, one in enumerate(sets):
        for j in {j for word in one for j in holders[word] if j > k and len(one) >= similarity * len(sets[j]) - 1e-9}:
            two = sets[j]
            shared = len(one & two)
            if shared >= similarity * (len(one) + len(two) - shared) - 1e-9:
                later.add(max(one, two, key=first.get))
    out = []
    for key, text in rows:
        if key is None or text is None:
            out.append((key, text, 0))
            continue
        gone = [n for n in range(text.count("\n") + 1) if (key, n) in lines and (first[lines[key, n]] != (key, n) or lines[key, n] in later)]
        kept = [x for n, x in enumerate(text.split("\n")) if n not in gone]
        out.append((key, "\n".join(kept), len(gone)))
    return sorted(out, key=repr)


def as_rows(frame):
    rows = frame.withColumn("n", linededup.worded_lines(frame["text"])).collect()
    return sorted(((r["doc_id"], r["text"], r["_removed"]) for r in rows), key=repr)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert as_rows(linededup.deduped(docs)) == plain_dedup(rows)


@pytest.mark.parametrize("crowd", [2, 12, 400])
@pytest.mark.parametrize("bins", [16, 1 << 22])
def test_random_lines(spark, monkeypatch, crowd, bins):
    """Few words, so that all are common, in lines of many sizes, near copies among them; with bins shared by many words."""
    monkeypatch.setattr(linededup, "CROWD", crowd)
    monkeypatch.setattr(linededup, "BINS", bins)
    monkeypatch.setattr(linededup, "BLOCK", min(bins, 1 << 16))
    rng = random.Random(crowd * bins)
    words = [f"w{k}" for k in range(40)]
    lines = [" ".join(rng.choices(words, k=rng.randrange(1, 25))) for _ in range(150)]
    for _ in range(250):
        line = rng.choice(lines).split()
        line[rng.randrange(len(line))] = rng.choice(words)
        lines.append(" ".join(line))
    rng.shuffle(lines)
    rows = [(k, "\n".join(rng.choices(lines, k=rng.randrange(1, 8)))) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert as_rows(linededup.deduped(docs)) == plain_dedup(rows)


def test_hot_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(linededup, "CROWD", 20)
    rng = random.Random(8)
    base = [f"b{k}" for k in range(30)]
    rows = []
    for key in range(150):
        line = list(base)
        for place in rng.sample(range(30), rng.randrange(4)):
            line[place] = f"x{rng.randrange(10**6)}"
        rows.append((key, " ".join(line) + "\nthe same line for all\n" + f"own {key} words here {key + 1000} now"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(linededup.deduped(docs)) == plain_dedup(rows)


def test_crowded_sets_meet_once_and_earlier_ones_only(spark, monkeypatch):
    """One line in all tasks, and near copies of it: neither the tasks nor the copies multiply the pairs looked at."""
    monkeypatch.setattr(linededup, "CROWD", 20)
    base = [f"b{k}" for k in range(12)]
    rows = [(k, "\n".join([" ".join(base), " ".join([*base[: k % 12], f"x{k}", *base[k % 12 + 1 :]])])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(10).cache()
    met, join = [], type(docs).join

    def counted(frame, other, on=None, how=None):
        if how == "left_anti" and on == ["a", "b"]:  # of all pairs looked at, those that aren't verified yet go on
            met.append(frame.count())
        return join(frame, other, on, how)

    monkeypatch.setattr(type(docs), "join", counted)
    assert as_rows(linededup.deduped(docs)) == plain_dedup(rows)
    assert len(met) == 1 and met[0] <= len(rows)


def test_nulls_empties_repeats_and_clashing_columns(spark):
    long = " ".join(f"v{k}" for k in range(20_000))
    rows = [
        (3, "A b c d\n\n  \nb a C d"),
        (1, None),
        (2, ""),
        (None, "a b c d"),
        (4, "a b c d e\na b c d"),
        (5, long),
        (6, long + " extra\nfresh one"),
        (7, "twice told"),
        (7, "twice told"),
    ]
    docs = spark.createDataFrame([(k, t, 1, 2, [3]) for k, t in rows], "doc_id long, text string, _id int, _of int, _Cut array<int>")
    assert as_rows(linededup.deduped(docs)) == plain_dedup(rows)
    kept = linededup.without_repeats(docs.withColumn("_removed", docs["_id"]))
    assert kept.columns == [*docs.columns, "_removed"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 2, 3, None, 5, 6, 7, 7], key=repr)
    assert linededup.deduped(docs.limit(0)).collect() == []


def test_lines_are_cut_without_python_and_nothing_else_stays_on_disk(spark, left):
    """Where no two rows share a key, cutting needs no Python; of all that was written only what the result reads is left."""
    rows = [(k, f"the same line for all\nown {k} words here {k + 1000} now") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = linededup.without_repeats(docs)
    assert left() == ["line-again", "line-removed"]
    assert "Python" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["text"].count("\n") for r in kept.collect()) == [0] * 19 + [1]
    # A key that rows repeat still has its lines told by their words.
    repeated = docs.unionByName(docs.where("doc_id = 7").withColumn("text", docs["text"].substr(1, 6)))
    alike = [row for row in as_rows(linededup.deduped(repeated)) if row[0] == 7]
    assert alike == [(7, "own 7 words here 1007 now", 1), (7, "the sa", 0)]


def test_query(spark):
    import hashlib

    from millrace.llm.queries import op3_line_dedup

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    many = {k: sum(bool(line.split()) for line in (t or "").encode().split(b"\n")) for k, t in rows}
    expected = [(k, many[k], gone, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for k, t, gone in plain_dedup(rows)]
    assert sorted(map(tuple, op3_line_dedup(spark, SF).collect())) == sorted(expected)
