"""Line dedup: an exact set-similarity join over the lines of all documents, later matches removed.

A line is the set of its words. Lines are equal if their sets are, and match if the Jaccard similarity of their sets is
``similarity`` or more; of lines that match, only those without an earlier match (by document, then line) stay.

Words are ordered by rarity, the rarest first; two sets that match share one of their first words, as many as the size
leaves room for. Each set is filed under those of its first words that occur more than once; sets filed under the same
word are compared by size, by place (how many words can still be shared behind it) and by a parity signature, whose
differing bits never exceed the differing words. What is left is verified on the words themselves. Rarity comes from
counts of all lines in a fixed number of bins: bins shared by several words change the order, never the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import give_back, pieces, unused
from millrace.session import settle, settle_alone

SIMILARITY = 0.8
#: Bins of the word counts: a byte each once ranked, 4 MB, whatever the vocabulary.
BINS = 1 << 22
BLOCK = 1 << 16
#: Words that occur more often than this are crowded: sets filed there are first compared with the earliest alone.
CROWD = 400
#: Bits that tell which lines are wanted for verification, 4 MB; more lines than bits only mean that more are looked at.
WANTED = 1 << 25
#: Wanted lines up to which their documents are picked out beforehand.
FEW = 1000

#: Characters of texts worked on at once, so that the words met in them stay near the processor.
PIECE = 400_000

LINES = "_id {id}, _line int, _set long, _size int, _skip int, _keys array<long>, _crowded array<long>, _one long, _two long"


class Numbers(dict):
    """Words in the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def word_hashes(words) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(word, 7) for word in words), np.uint64, len(words))


def _mixed(hashes: np.ndarray) -> np.ndarray:
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


def _name_parts(mixed: np.ndarray) -> np.ndarray:
    """Numbers whose sum names a set of words."""
    return mixed * np.uint64(0xBF58476D1CE4E5B9)


def plain(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def rank_of(many: np.ndarray) -> np.ndarray:
    """Counts as ranks that fit a byte: themselves up to 32, then eight to an octave."""
    return np.where(many <= 32, many, np.minimum(255, 33 + 8 * np.log2(np.maximum(many, 32) / 32))).astype(np.uint8)


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """A rank for each bin of words: how often its words occur (``rank_of``).

    A task hands on its counts by blocks of bins, packed; blocks are summed and ranked one by one, a batch at a time, and
    reach the driver as 64 blocks of bytes.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, np.int64)
        for rows in batches:
            for held in pieces(rows.column("_text").to_pylist(), PIECE):
                words: Counter = Counter()
                for text in held:
                    words.update(plain(text).split())
                bins = (word_hashes(words) & np.uint64(BINS - 1)).astype(np.int64)
                np.add.at(counts, bins, np.fromiter(words.values(), np.int64, len(words)))
        give_back()
        for start in range(0, BINS, BLOCK):
            used = np.flatnonzero(counts[start : start + BLOCK])
            if len(used):
                packed = used.astype(np.int32).tobytes(), counts[start + used].tobytes()
                arrays = [pa.array([start // BLOCK], pa.int32()), *[pa.array([x], pa.binary()) for x in packed]]
                yield pa.RecordBatch.from_arrays(arrays, names=["_block", "_bins", "_counts"])

    def ranked(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BLOCK, np.int64)
        for rows in batches:
            for bins, many in zip(rows.column("_bins"), rows.column("_counts"), strict=True):
                sums[np.frombuffer(bins.as_py(), np.int32)] += np.frombuffer(many.as_py(), np.int64)
        out = np.where(sums > 0, rank_of(sums.astype(np.float64)), 0).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["_block", "_ranks"])

    packed = docs.select(F.col(text).alias("_text")).mapInArrow(counted, "_block int, _bins binary, _counts binary")
    blocks = packed.groupBy("_block").applyInArrow(ranked, "_block int, _ranks binary")
    ranks = np.zeros(BINS, np.uint8)
    for row in blocks.collect():
        ranks[row["_block"] * BLOCK : (row["_block"] + 1) * BLOCK] = np.frombuffer(row["_ranks"], np.uint8)
    return ranks


def _needed(size, similarity: float):
    """Words that a set of ``size`` shares with any match at least."""
    return np.ceil(similarity * size - 1e-9).astype(np.int64)


def line_sets(docs: DataFrame, ranks: np.ndarray, similarity: float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per line with words: its document and number, its set's hash and size, the words it is filed under (after
    ``_skip`` words that no other line can have; crowded ones apart, they come last), and its signature. Of equal lines
    a task files the first."""
    crowd = int(rank_of(np.array([CROWD], np.float64))[0])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed_before: set[int] = set()

        def lists(values: np.ndarray, of: np.ndarray, many: int) -> pa.Array:
            """Values, their lines in ascending order, as a list per line."""
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=many))])
            return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))

        for rows in batches:
            at = 0
            for held in pieces(rows.column("_text").to_pylist(), PIECE):
                words: list[bytes] = []
                sizes: list[int] = []
                per_text = []
                for one_text in held:
                    parts = plain(one_text).split(b"\n")
                    per_text.append(len(parts))
                    for line in parts:
                        own = line.split()
                        words += own
                        sizes.append(len(own))
                ids = rows.column("_id").slice(at, len(held))
                at += len(held)
                if not words:
                    continue
                # The piece's words by rarity, then hash; lines sort by that place, and repeated words meet.
                numbers = Numbers()
                known = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                hashes = word_hashes(numbers)
                rank = ranks[(hashes & np.uint64(BINS - 1)).astype(np.int64)]
                order = np.argsort(rank.astype(np.uint64) << np.uint64(56) | hashes >> np.uint64(8))
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                every = np.sort(np.repeat(np.arange(len(sizes)), sizes) << 32 | place[known])
                fresh = np.ones(len(every), bool)
                fresh[1:] = every[1:] != every[:-1]
                every = every[fresh]
                line_of, word = every >> 32, order[every & 0xFFFFFFFF]
                many = np.bincount(line_of, minlength=len(sizes))
                has = np.flatnonzero(many)
                size = many[has]
                begin = np.cumsum(size) - size
                of = np.repeat(np.arange(len(has)), size)
                mixed = _mixed(hashes)
                bit = mixed >> np.uint64(57)
                flag = np.uint64(1) << (bit & np.uint64(63))
                name = np.add.reduceat(_name_parts(mixed)[word], begin)
                one = np.bitwise_xor.reduceat(np.where(bit < 64, flag, np.uint64(0))[word], begin)
                two = np.bitwise_xor.reduceat(np.where(bit >= 64, flag, np.uint64(0))[word], begin)
                seen = np.zeros(len(has), bool)
                for k, value in enumerate(name.tolist()):
                    if value in filed_before:
                        seen[k] = True
                    else:
                        if len(filed_before) >= 1_000_000:  # filed twice is harmless
                            filed_before.clear()
                        filed_before.add(value)
                rank = rank[word]
                first = np.arange(len(word)) - begin[of] < (size - _needed(size, similarity) + 1)[of]
                # Below four words only equal sets match at 0.8; a word that occurs once matches nothing.
                filed = first & (rank > 1) & ~seen[of] & (size * (1 - similarity) >= similarity - 1e-9)[of]
                full = filed & (rank >= crowd)
                hashes = hashes[word]
                doc = np.repeat(np.arange(len(held)), per_text)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(doc[has])),
                        pa.array(number[has].astype(np.int32)),
                        pa.array(name.view(np.int64)),
                        pa.array(size.astype(np.int32)),
                        pa.array(np.bincount(of, weights=first & (rank <= 1), minlength=len(has)).astype(np.int32)),
                        lists(hashes[filed & ~full], of[filed & ~full], len(has)),
                        lists(hashes[full], of[full], len(has)),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                    ],
                    names=["_id", "_line", "_set", "_size", "_skip", "_keys", "_crowded", "_one", "_two"],
                )
        filed_before.clear()
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(found, LINES.format(id=kind))


def _may_match(similarity: float) -> Column:
    """Whether sets of two rows (a_ and b_) filed under one word can match: sizes, places and signatures allow it."""
    a, b = F.shiftright("a_at", 32), F.shiftright("b_at", 32)
    behind = F.least(a - F.col("a_at").bitwiseAND(F.lit(0x7FFFFFFF)), b - F.col("b_at").bitwiseAND(F.lit(0x7FFFFFFF)))
    shared = F.ceil(F.lit(similarity / (1 + similarity)) * (a + b) - 1e-9)
    apart = F.bit_count(F.col("a_one").bitwiseXOR(F.col("b_one"))) + F.bit_count(F.col("a_two").bitwiseXOR(F.col("b_two")))
    return (F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9) & (apart <= a + b - 2 * shared) & (behind >= shared)


def _filed(rows: DataFrame, keys: str, before: Column, side: str, *more: str) -> DataFrame:
    """A row for each word that a set is filed under, its columns named for one side of a join; size and place of the
    word in it are one number."""
    out = rows.select("_set", "_size", "_one", "_two", *more, before.alias("_before"), F.posexplode(keys).alias("_at", "_key"))
    at = F.shiftleft(F.col("_size").cast("long"), 32).bitwiseOR((F.col("_before") + F.col("_at")).cast("long")).alias(f"{side}_at")
    return out.select("_key", at, *[F.col(f"_{x}").alias(f"{side}_{x}") for x in ("set", "one", "two", *[m[1:] for m in more])])


def _similar(a: str, b: str, similarity: float) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared >= F.lit(similarity) * (F.size(a) + F.size(b) - shared) - 1e-9


def words_at(docs: DataFrame, places: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``_set`` and its ``_words`` for the lines (``_id``, ``_line``) of ``places``.

    Only those lines are shuffled: documents are looked through where they lie, with a bit for each line wanted.
    """
    spot = F.pmod(F.xxhash64(F.col("_id").cast("string"), "_line"), F.lit(WANTED)).alias("_spot")
    bits = places.select(spot).groupBy(F.shiftright("_spot", 6).cast("int").alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_spot & 63 as int))")).alias("_bits")
    )
    flags = np.zeros(WANTED >> 6, np.int64)
    known = bits.toPandas()
    flags[known["_word"].to_numpy()] = known["_bits"].to_numpy()

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at, lines, words = [], [], []
            many = np.diff(rows.column("_spots").offsets.to_numpy())
            spots = rows.column("_spots").flatten().to_numpy()
            of = np.repeat(np.arange(len(many)), many)
            line = np.arange(len(spots)) - np.repeat(np.cumsum(many) - many, many)
            hit = np.flatnonzero(flags[spots >> 6] >> (spots & 63) & 1)
            before, parts = -1, []
            for k, n in zip(of[hit].tolist(), line[hit].tolist(), strict=True):
                if k != before:  # a text without a line that is wanted stays as it came
                    before, parts = k, plain(rows.column("_text")[k].as_py()).split(b"\n")
                at.append(k)
                lines.append(n)
                words.append(np.unique(word_hashes(parts[n].split())).view(np.int64))
            if at:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(np.int32)
                kept = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(words)))
                yield pa.RecordBatch.from_arrays([rows.column("_id").take(pa.array(at)), pa.array(lines, pa.int32()), kept], names=["_id", "_line", "_words"])
        give_back()

    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    if len(known) < FEW:  # so few lines that their documents alone are handed to Python
        rows = rows.join(F.broadcast(places.select("_id").distinct()), "_id", "left_semi")
    many = F.char_length("_text") - F.char_length(F.replace("_text", F.lit("\n"), F.lit("")))
    rows = rows.withColumn("_named", F.col("_id").cast("string")).withColumn("_many", many)
    rows = rows.select("_id", "_text", F.expr(f"transform(sequence(0, _many), n -> pmod(xxhash64(_named, n), {WANTED}L))").alias("_spots"))
    kind = docs.schema[key].dataType.simpleString()
    found = rows.mapInArrow(picked, f"_id {kind}, _line int, _words array<long>")
    return found.join(places, ["_id", "_line"]).select("_set", "_words").dropDuplicates(["_set"])


def verified(docs: DataFrame, pairs: DataFrame, firsts: DataFrame, similarity: float, text: str, key: str) -> DataFrame:
    """Those of ``pairs`` (a, b) of sets that match, as their words have it."""
    pairs = settle(pairs.distinct(), "line-pairs")
    if pairs.isEmpty():  # no reason to look through the documents
        return pairs.select("a", "b")
    wanted = pairs.select(F.col("a").alias("_set")).union(pairs.select(F.col("b").alias("_set"))).distinct()
    places = settle(firsts.join(wanted, "_set").select("_set", "_first._id", "_first._line"), "line-places")
    known = settle(words_at(docs, places, text, key), "line-words")
    one, two = (known.select(F.col("_set").alias(side), F.col("_words").alias(f"_{side}w")) for side in "ab")
    return settle(pairs.join(one, "a").join(two, "b").where(_similar("_aw", "_bw", similarity)).select("a", "b"), "line-matches")


def matches(docs: DataFrame, lines: DataFrame, firsts: DataFrame, similarity: float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Sets that have an earlier match: pairs (a, b) of sets, every set with an earlier match in at least one whose other
    set is earlier than it. ``firsts``: where each set is first."""
    may = _may_match(similarity)
    ends = F.col("a_set").alias("a"), F.col("b_set").alias("b")
    # Words that few lines hold: every two sets that can match.
    sides = [_filed(lines, "_keys", F.col("_skip"), side) for side in "ab"]
    near = sides[0].join(sides[1], "_key").where((F.col("a_set") < F.col("b_set")) & may).select(*ends)
    # Crowded words: each set, once however many tasks filed it, against the earliest one there first; those that it
    # doesn't settle against the earlier ones alone, since a later match settles nothing.
    full = lines.where("size(_crowded) > 0").select("_set", "_size", "_skip", F.size("_keys").alias("_few"), "_crowded", "_one", "_two")
    full = settle(full.dropDuplicates(["_set"]).join(firsts, "_set"), "line-crowds")
    behind = F.col("_skip") + F.col("_few")
    here = _filed(full, "_crowded", behind, "a", "_first")
    head = here.groupBy("_key").agg(F.min(F.struct(*[F.col(f"a_{x}").alias(f"b_{x}") for x in ("first", "set", "at", "one", "two")])).alias("_b"))
    first = here.join(head, "_key").select("*", "_b.*").where((F.col("a_set") != F.col("b_set")) & may).select(*ends)
    sure = verified(docs, near.union(first), firsts, similarity, text, key)
    # Settled: later than a match.
    sides = [firsts.select(F.col("_set").alias(side), F.col("_first").alias(f"_{side}")) for side in "ab"]
    placed = sure.join(sides[0], "a").join(sides[1], "b")
    settled = placed.select(F.when(F.col("_a") > F.col("_b"), F.col("a")).otherwise(F.col("b")).alias("_set")).distinct()
    rest = full.join(settled, "_set", "left_anti")
    late = _filed(rest, "_crowded", behind, "a", "_first").join(_filed(full, "_crowded", behind, "b", "_first"), "_key")
    late = late.where((F.col("b_first") < F.col("a_first")) & may).select(F.least("a_set", "b_set").alias("a"), F.greatest("a_set", "b_set").alias("b"))
    return sure.union(verified(docs, late.join(sure, ["a", "b"], "left_anti"), firsts, similarity, text, key))


def removed_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """The lines (``_id``, ``_line``, ``_set``) that have an earlier match."""
    return settle_alone(docs.sparkSession, lambda: _removed_lines(docs, text, key, similarity), "line-removed")


def _removed_lines(docs: DataFrame, text: str, key: str, similarity: float) -> DataFrame:
    lines = settle(line_sets(docs, rarity(docs, text), similarity, text, key), "lines")
    firsts = settle(lines.groupBy("_set").agg(F.min(F.struct("_id", "_line")).alias("_first")), "line-sets")
    met = matches(docs, lines, firsts, similarity, text, key)
    sides = [firsts.select(F.col("_set").alias(s), F.col("_first").alias(f"_{s}")) for s in "ab"]
    placed = met.join(sides[0], "a").join(sides[1], "b")
    later = placed.select(F.when(F.col("_a") > F.col("_b"), F.col("a")).when(F.col("_b") > F.col("_a"), F.col("b")).alias("_set")).where("_set is not null").distinct()
    marked = firsts.join(later.withColumn("_later", F.lit(True)), "_set", "left")
    gone = lines.select("_id", "_line", "_set").join(marked, "_set")
    gone = gone.where((F.struct("_id", "_line") != F.col("_first")) | F.coalesce("_later", F.lit(False)))
    return gone.select("_id", "_line", "_set").distinct()


def deduped(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, removed: str = "_removed") -> DataFrame:
    """``docs`` with the later ones of matching lines cut from ``text``, and ``removed``, how many lines each row lost.

    Lines are told by their words, lower-cased, whatever their order and number. Lines without words stay. Nulls stay
    null; rows without a key are left as they are. Rows that repeat a key are one document: a line of theirs goes from
    all of them if the words at its place are the same.
    """
    gone = removed_lines(docs, text, key, similarity)
    (of,) = unused(docs.columns, "_of")
    again = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(of)).agg(F.count("*").alias("_n")).where("_n > 1").select(of)
    again = settle(again, "line-again")
    if again.isEmpty():
        return _cut(docs, gone, text, key, removed)
    named = F.col(key) == F.col(of)
    alone = _cut(docs.join(again, named, "left_anti"), gone, text, key, removed)
    return alone.unionByName(_cut_repeated(docs.join(again, named, "left_semi"), gone, text, key, removed))


def _cut(docs: DataFrame, gone: DataFrame, text: str, key: str, removed: str) -> DataFrame:
    """``docs`` without the lines of ``gone``, for keys that one row has."""
    of, lost = unused(docs.columns, "_of", "_gone")
    lists = gone.groupBy(F.col("_id").alias(of)).agg(F.collect_set("_line").alias(lost))
    joined = docs.join(lists, F.col(key) == F.col(of), "left").drop(of)
    left = F.filter(F.split(text, "\n"), lambda line, n: ~F.array_contains(lost, n))
    many = F.when(F.col(lost).isNotNull(), F.size(lost)).otherwise(0).cast("long")
    cut = F.when(F.col(lost).isNotNull(), F.array_join(left, "\n")).otherwise(F.col(text))
    return joined.withColumn(removed, many).withColumn(text, cut).drop(lost)


def _cut_repeated(docs: DataFrame, gone: DataFrame, text: str, key: str, removed: str) -> DataFrame:
    """The same where rows repeat a key: a line goes if the words at its place are those of the line that went."""
    of, lost, done = unused(docs.columns, "_of", "_gone", "_cut")
    lists = gone.groupBy(F.col("_id").alias(of)).agg(F.collect_list(F.struct(F.col("_line").alias("line"), F.col("_set").alias("set"))).alias(lost))

    @F.pandas_udf("text string, removed long")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def same(line: str, name: int) -> bool:
            mixed = _mixed(np.unique(word_hashes(plain(line).split())))
            return int(_name_parts(mixed).sum(dtype=np.uint64).astype(np.int64)) == name

        for texts, lists in batches:
            rows = []
            for value, asked in zip(texts, lists, strict=True):
                drop: set[int] = set()
                if isinstance(value, str) and asked is not None:
                    parts = value.split("\n")
                    drop = {one["line"] for one in asked if one["line"] < len(parts) and same(parts[one["line"]], one["set"])}
                    if drop:
                        value = "\n".join(x for k, x in enumerate(parts) if k not in drop)
                rows.append((value, len(drop)))
            yield pd.DataFrame(rows, columns=["text", "removed"])
        give_back()

    joined = docs.join(lists, F.col(key) == F.col(of), "left").drop(of)
    joined = joined.withColumn(done, cut(F.col(text), F.col(lost))).drop(lost)
    return joined.withColumn(text, F.col(done)["text"]).withColumn(removed, F.col(done)["removed"]).drop(done)


def worded_lines(text: Column) -> Column:
    """How many lines of a text have words; none of a null."""
    return F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0)).cast("long")


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with matching lines cut; rows whose every line with words went, being copies throughout, go."""
    (removed,) = unused(docs.columns, "_removed")
    rows = deduped(docs, text, key, similarity, removed)
    return rows.where((F.col(removed) == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]")).select(docs.columns)
