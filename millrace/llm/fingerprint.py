"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A document is its words, each weighted by how often it occurs. For sample k every word draws r and c from Gamma(2, 1) and b
from the unit interval, the same wherever the word occurs; with t = floor(ln weight / r + b) the word's value is
ln c - r (t - b + 1), and the least value among a document's words is the sample. A value is that of one word and one t,
so two documents have the same sample with a probability equal to the generalised Jaccard similarity of their weights, the
sum of the lesser weights over the sum of the greater ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACES
from millrace.operators.ordered import place_in_order
from millrace.session import fresh_path, settle

#: Samples in a fingerprint: a likeness of 0.6 is told to about 0.09.
SAMPLES = 32


def sample_value(word: str, weight: str, k: int) -> Column:
    """The value that a word (its hash, a long) of a weight has for sample ``k``."""
    one, two = f"xxhash64({word}, {2 * k})", f"xxhash64({word}, {2 * k + 1})"
    # 21 bits each for r's two draws and b; 31 each for c's, whose least values matter.
    first = f"((({one} & 2097151L) + 0.5D) / 2097152D)"
    second = f"(((shiftright({one}, 21) & 2097151L) + 0.5D) / 2097152D)"
    third = f"(((shiftright({one}, 42) & 2097151L) + 0.5D) / 2097152D)"
    fourth = f"((({two} & 2147483647L) + 0.5D) / 2147483648D)"
    fifth = f"(((shiftright({two}, 31) & 2147483647L) + 0.5D) / 2147483648D)"
    r = f"(-ln({first} * {second}))"
    return F.expr(f"ln(-ln({fourth} * {fifth})) - {r} * (floor(ln({weight}) / {r} + {third}) - {third} + 1D)")


def samples(words: DataFrame, keys: list[str], word: str, many: int = SAMPLES) -> DataFrame:
    """The samples of each key as array<long>, from rows of its words (longs), repeated as often as they occur."""
    weighed = words.groupBy(*keys, word).agg(F.count("*").cast("double").alias("_weight"))
    least = weighed.groupBy(*keys).agg(*[F.min(sample_value(word, "_weight", k)).alias(f"_s{k}") for k in range(many)])
    return least.select(*keys, F.array(*[F.xxhash64(f"_s{k}") for k in range(many)]).alias("_samples"))


def words_of(text: Column) -> Column:
    """Words between white space."""
    return F.split(text, SPACES)


def likeness(one: Column, two: Column, many: int = SAMPLES) -> Column:
    """Share of the samples that two fingerprints have in common; documents without words are alike."""
    same = sum((F.when(one[k] == two[k], 1).otherwise(0) for k in range(1, many)), F.when(one[0] == two[0], 1).otherwise(0))
    return F.when(one.isNull() & two.isNull(), 1.0).when(one.isNull() | two.isNull(), 0.0).otherwise(same / F.lit(float(many)))


def written(prints: Column, many: int = SAMPLES) -> Column:
    """A fingerprint as eight hex digits a sample; without words, zeros."""
    parts = [F.lpad(F.lower(F.hex(prints[k].bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0") for k in range(many)]
    return F.when(prints.isNull(), F.lit("0" * (8 * many))).otherwise(F.concat(*parts))


#: What names a document: whether its key is null, the key, and the hash of its text.
KEYS = ["_none", "_id", "_hash"]


def named(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``KEYS`` and ``_text``; a null text is an empty one, a null key a zero of its own."""
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    zero = F.lit("0").cast(rows.schema["_id"].dataType)
    return rows.select(F.col("_id").isNull().alias("_none"), F.coalesce("_id", zero).alias("_id"), F.xxhash64("_text").alias("_hash"), "_text")


def in_order(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Documents (``KEYS``, ``_chars``, ``_copies``) and the keys of the one after each (``_next_...``), by ascending key, null
    keys first, then by hash of the text; after the last comes the first.

    Only keys, hashes and lengths are put in order, range-partitioned, so no task holds all of them.
    """
    rows = named(docs, text, key).withColumn("_chars", F.char_length("_text").cast("long"))
    each = rows.groupBy(*KEYS).agg(F.max("_chars").alias("_chars"), F.count("*").alias("_copies")).withColumn("_some", ~F.col("_none"))
    spark = docs.sparkSession
    each = each.withColumn("_all", F.lit(0))
    placed = settle(place_in_order(each, fresh_path(spark, "in-order"), "_all", ["_some", "_id", "_hash"]).drop("_all", "_some"), "placed")
    many = max(1, placed.count())
    follow = placed.select(*[F.col(x).alias(f"_next{x}") for x in KEYS], F.pmod(F.col("offset") - 1, F.lit(many)).alias("offset"))
    return settle(placed.join(follow, "offset").drop("offset"), "followed")


def against_next(docs: DataFrame, text: str = "text", key: str = "doc_id", many: int = SAMPLES) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, the last quarter replaced by as much of the next
    document's beginning: ``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and
    ``near_next``.

    Rows that repeat key and text are one document, whose result is repeated. A null text is empty; a null key comes
    first. Whole texts are shuffled by key; only the quarters that replace others travel again.
    """
    chain = in_order(docs, text, key)
    texts = named(docs, text, key)
    # The beginning of each document for the one before it.
    asked = chain.select(*[F.col(f"_next{x}").alias(x) for x in KEYS], *[F.col(x).alias(f"_of{x}") for x in KEYS], "_chars")
    heads = texts.join(asked, KEYS).select(
        *[F.col(f"_of{x}").alias(x) for x in KEYS], F.col("_chars").alias("_n"), F.expr("left(_text, cast(floor(_chars / 4) as int))").alias("_head")
    )
    edited = F.concat(F.expr("left(_text, cast(_n - floor(_n / 4) as int))"), "_head").alias("_edited")
    both = texts.join(heads.dropDuplicates(KEYS), KEYS).select(*KEYS, "_text", edited).dropDuplicates(KEYS)
    # Words of the text, of the edited text, and the latter's digest as a row of its own kind.
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.lit(None).cast("string").alias("sha"), words_of(F.col("_text")).alias("words")),
        F.struct(F.lit(1).alias("kind"), F.lit(None).cast("string").alias("sha"), words_of(F.col("_edited")).alias("words")),
        F.struct(F.lit(2).alias("kind"), F.sha2("_edited", 256).alias("sha"), F.array(F.lit("-")).alias("words")),
    )
    rows = both.select(*KEYS, F.explode(kinds).alias("_x")).select(*KEYS, "_x.kind", "_x.sha", F.explode("_x.words").alias("_word"))
    rows = rows.where("_word <> ''").select(*KEYS, "kind", "sha", F.xxhash64("_word").alias("_word"))
    found = samples(rows, [*KEYS, "kind", "sha"], "_word", many)
    prints = settle(
        found.groupBy(*KEYS).agg(
            F.max("sha").alias("edited_sha256"),
            F.max(F.when(F.col("kind") == 0, F.col("_samples"))).alias("_own"),
            F.max(F.when(F.col("kind") == 1, F.col("_samples"))).alias("_edited"),
        ),
        "prints",
    )
    after = prints.select(*[F.col(x).alias(f"_next{x}") for x in KEYS], F.col("_own").alias("_after"))
    joined = chain.join(prints, KEYS).join(after, [f"_next{x}" for x in KEYS])
    return joined.select(
        F.when(~F.col("_none"), F.col("_id")).alias(key),
        F.col("_chars").alias("n_chars"),
        "edited_sha256",
        written(F.col("_own"), many).alias("fingerprint"),
        written(F.col("_edited"), many).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited"), many).alias("near_edited"),
        likeness(F.col("_own"), F.col("_after"), many).alias("near_next"),
        F.explode(F.expr("sequence(1L, _copies)")).alias("_copy"),
    ).drop("_copy")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", many: int = SAMPLES) -> DataFrame:
    """``key`` and ``fingerprint`` of each row; equal texts have equal ones, and a null text is an empty one."""
    texts = named(docs, text, key)
    words = texts.dropDuplicates(["_hash"]).select("_hash", F.explode(words_of(F.col("_text"))).alias("_word")).where("_word <> ''")
    found = samples(words.select("_hash", F.xxhash64("_word").alias("_word")), ["_hash"], "_word", many)
    rows = texts.select(F.when(~F.col("_none"), F.col("_id")).alias(key), "_hash").join(found, "_hash", "left")
    return rows.select(key, written(F.col("_samples"), many).alias("fingerprint"))
