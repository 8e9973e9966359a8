"""The pipeline: stages one after the other, planted cases, and odd rows through every stage."""

import random

import pytest

import corpus_pipeline
from millrace.llm import bpe, queries

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    """A folder of tables with planted toxic documents, copies, near copies and leaks among clean ones."""
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    lines = lambda n: "\n".join(fresh(20) for _ in range(n))
    items = [(k, fresh(30)) for k in range(5)]
    rows, labels = {}, []
    for key in range(100):
        toxic = key % 5 == 4
        rows[key] = lines(4) + (" horrid horridly" if toxic else "")
        labels.append((key, 1, int(toxic)))
    rows[200], rows[201] = rows[10], rows[11] + "\n" + lines(3)  # a copy, and a document that holds another
    words = rows[12].replace("\n", " ").split()
    rows[202] = " ".join(words)  # its lines run together
    rows[203] = fresh(40) + "\n" + items[2][1] + "\n" + fresh(40)
    table = [(k, t, "en", "s", len(t)) for k, t in rows.items()] + [(300, None, None, None, None), (301, "", "en", "s", 0), (None, fresh(50), "en", "s", 1)]
    spark.createDataFrame(table, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_planted_cases(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        path = f"{folder}/{name.replace(' ', '-')}"
        after.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    toxic, deduped, near, clean = kept
    assert set(toxic) == {k for k in range(100) if k % 5 != 4} | {200, 201, 202, 203, 300, 301, None}
    assert 200 not in deduped and deduped[201].count("\n") == 2 and 202 in deduped
    assert 202 not in near and {12, 201, 203} <= set(near)
    assert set(clean) == set(near) - {203}
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    codec = bpe.Codec(bpe.vocabulary(queries.vocabulary_path()))
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == {k: codec.digest(t or "") for k, t in clean.items()}


def test_run_is_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    rows = lambda frame: sorted(map(tuple, frame.collect()), key=repr)
    assert rows(corpus_pipeline.run(spark, folder)) == rows(docs)


def test_stages_keep_extra_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "array(1) as _id", "map('a', 1) as _text", "1 as a")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        assert after.count()
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_given_tables(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(rows) <= 200 and len({r["doc_id"] for r in rows}) == len(rows)
