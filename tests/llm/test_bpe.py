"""BPE against the tokenizers library, and its trees against a plain search for the lowest pair."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe
from millrace.llm.queries import vocabulary_path

SF = "/root/testdata/sf0.001"
ODD = [
    "",
    " ",
    "\n",
    "a<|endoftext|>b <|endoftext|>  c",
    "  \n\t x  \n",
    "日本語 テスト࢏՘x",
    "é \x1c \x85  x's don't I'LL 12³½",
    "x" * 3000,
    "ab " * 2000,
    "�\x00퟿😀👩‍👩",
    " <|endoftext|> ",
    "one two  three\tfour \nfive",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary_path())
    own.no_truncation()
    own.no_padding()
    return own


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.vocabulary(vocabulary_path()))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))


def test_odd_texts(library, codec):
    assert codec.digests(ODD) == [expected(library, text) for text in ODD]
    for text in ODD:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_parts_of_characters(library, codec):
    for ids in ([50255, 200, 201], [127, 255], [50256, 10]):
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(library, codec, text):
    assert codec.digests([text]) == [expected(library, text)]


def test_trees_against_plain_search():
    rng = random.Random(3)
    ranks, pairs = {}, [(a, b) for a in range(4) for b in range(4)]
    made = 4
    for rank in range(12):
        pair = rng.choice([p for p in pairs if p not in ranks])
        ranks[pair] = (rank, made)
        pairs += [(made, x) for x in range(made + 1)] + [(x, made) for x in range(made)]
        made += 1

    def plain(symbols):
        symbols = list(symbols)
        while True:
            found = [(ranks[p][0], k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
            if not found:
                return symbols
            _, k = min(found)
            symbols[k : k + 2] = [ranks[symbols[k], symbols[k + 1]][1]]

    words = [[rng.randrange(4) for _ in range(rng.randrange(1, 30))] for _ in range(300)]
    assert [bpe.merge(word, ranks) for word in words] == [plain(word) for word in words]
    trees = bpe.ManyTrees(list(range(4)), ranks)
    assert [list(x) for x in trees.merge([bytes(word) for word in words], 32)] == [plain(word) for word in words]


def test_forgetting_changes_nothing(library):
    small = bpe.Codec(bpe.vocabulary(vocabulary_path()), remember=5)
    texts = ["the rain in spain stays mainly in the plain the rain"] * 3 + ODD
    assert small.digests(texts) == [expected(library, text) for text in texts]


def test_query(spark, library):
    from millrace.llm.queries import op2_bpe

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op2_bpe(spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == {k: expected(library, v or "") for k, v in texts.items()}


def test_nulls_repeats_and_other_columns(spark, library):
    docs = spark.createDataFrame(
        [(1, None, 7), (None, "a b", 8), (2, "a b", 9), (2, "a b", 9)], "doc_id long, text string, n_tokens int"
    )
    rows = sorted(tuple(r) for r in bpe.tokenized(docs, vocabulary_path()).na.fill({"doc_id": -1}).collect())
    full = expected(library, "a b")
    assert rows == [(-1, *full), (1, *expected(library, "")), (2, *full), (2, *full)]
    assert bpe.tokenized(docs.limit(0), vocabulary_path()).collect() == []


def test_round_trip_of_ids(spark):
    spec = bpe.vocabulary(vocabulary_path())
    docs = spark.createDataFrame([(text,) for text in ODD], "text string")
    back = docs.select("text", bpe.decode(bpe.encode(docs["text"], spec), spec).alias("back"))
    assert all(r["text"] == r["back"] for r in back.collect())
