"""SimHash near-duplicates, found by a generalised pigeonhole search.

A fingerprint's bits are the majority over the hashes of a text's word shingles. ``linked`` finds all fingerprints at a
few differing bits, exactly: bits that go together are put into the same partition, and each fingerprint gets its own
threshold per partition, chosen by dynamic programming on the candidates to expect. With m partitions and a radius r
thresholds that add up to r - m + 1 lose nothing, -1 meaning that a partition isn't probed. A fingerprint whose cheapest
choice still brings more than ``CROWD`` candidates is met half-way instead: two fingerprints differ in at most two bits
exactly if changing at most one bit in each gives the same number, and no number is reached from more than 65 of them.

``near_groups`` finds all texts whose shingle sets are similar, without fingerprints: by an exact prefix filter on sets.
``without_copies`` drops what the fingerprints link, then what only the sets do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, give_back, pieces, unused
from millrace.session import settle, settle_alone

BITS = 64
PARTS = 3
#: Candidates of one fingerprint beyond which it is met half-way: about as many as that makes rows.
CROWD = 64


def shingles(text: str, size: int) -> list[bytes]:
    """Word shingles of a text, repeats included; the whole sequence if it has fewer words, none if it has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)]


def majority(hashes: np.ndarray) -> np.ndarray:
    """For rows of 64-bit words: the words whose bits are set in over half the rows."""
    rows, words = hashes.shape
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8), axis=1, bitorder="little")
    counts = np.zeros(words * BITS, np.int64)
    for start in range(0, rows, 255):  # sums of 255 bits fit a byte
        counts += bits[start : start + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > rows, bitorder="little").view(np.uint64)


def spread(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` independent 64-bit numbers for each hash, the hash itself first."""
    if words == 1:
        return hashes[:, None]
    step = (np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    mixed = hashes[:, None] ^ step
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed[:, 1:] = (mixed[:, 1:] ^ (mixed[:, 1:] >> np.uint64(shift))) * np.uint64(factor)
    mixed[:, 1:] ^= mixed[:, 1:] >> np.uint64(31)
    return mixed


def fingerprint(text: Column, size: int = 3, words: int = 1, repeats: bool = True) -> Column:
    """Fingerprint of each text as array<long> of ``words`` numbers; zero for a text without words or a null.

    ``size``: words in a shingle. ``repeats``: whether a shingle counts each time it occurs.
    """

    @F.pandas_udf("array<long>")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from xxhash import xxh64_intdigest

        zero = np.zeros(words, np.int64)

        def one(value: str) -> np.ndarray:
            found = shingles(value, size)
            if not found:
                return zero
            hashes = np.fromiter((xxh64_intdigest(x, 42) for x in found), np.uint64, len(found))
            if not repeats:
                hashes = np.unique(hashes)
            step = max(1, 4_000_000 // (words * BITS))
            if len(hashes) <= step:
                return majority(spread(hashes, words)).view(np.int64)
            counts = np.zeros(words * BITS, np.int64)
            for start in range(0, len(hashes), step):
                part = np.unpackbits(spread(hashes[start : start + step], words).view(np.uint8), axis=1, bitorder="little")
                counts += part.sum(axis=0, dtype=np.int64)
            return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)

        for texts in batches:
            yield pd.Series([one(x) for held in pieces(texts) for x in held], dtype=object)
        give_back()

    return prints(text)


def together(prints: DataFrame, parts: int = PARTS) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size, those that vary together side by side.

    The 64 x 64 counts of bits set together come from all fingerprints; only they reach the driver.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS), np.int64)
        for rows in batches:
            words = rows["fp"].to_numpy(np.int64)
            bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        first, second = np.divmod(np.arange(BITS * BITS), BITS)
        yield pd.DataFrame({"i": first, "j": second, "n": total.ravel()})

    sums = prints.select("fp").mapInPandas(counted, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    both = np.zeros((BITS, BITS))
    for i, j, n in sums.collect():
        both[i, j] = n
    rows = max(1, prints.count())
    share = both / rows
    mean = np.diag(share)
    deviation = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    like = np.abs((share - np.outer(mean, mean)) / np.outer(deviation, deviation))
    np.fill_diagonal(like, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        room = len(left) // (parts - k)
        group = [max(left, key=lambda b: like[b, left].sum())]
        left.remove(group[0])
        while len(group) < room:
            group.append(max(left, key=lambda b: like[b, group].sum()))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _value(bits: list[int]) -> str:
    """SQL for the number that the bits of ``fp`` make."""
    return " | ".join(f"shiftleft(shiftright(fp, {bit}) & 1L, {k})" for k, bit in enumerate(bits))


def _within(width: int, radius: int) -> list[int]:
    """Masks of ``width`` bits with at most ``radius`` set."""
    return [sum(1 << k for k in chosen) for r in range(radius + 1) for chosen in combinations(range(width), r)]


def allocation(counts: np.ndarray, widths: list[int], rows: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds per partition for each fingerprint, and the candidates to expect, by dynamic programming.

    ``counts``: how many other fingerprints share its value in each partition. Within a distance t the share of
    an even spread over all values is added, and the own bucket's for each way to change t bits.
    """
    many, parts = counts.shape
    target = radius - parts + 1
    levels = list(range(-1, radius + 1))
    best = {0: (np.zeros(many), np.zeros(many), np.zeros((many, 0), np.int64))}
    for k, width in enumerate(widths):
        nearer: dict[int, tuple] = {}
        for total, (cost, expected, chosen) in best.items():
            for t in levels:
                masks = len(_within(width, t)) if t >= 0 else 0
                some = counts[:, k] * (t >= 0) * max(1, t * width) + masks * rows / 2.0**width
                now = cost + some + masks
                way = (now, expected + some, np.column_stack([chosen, np.full(many, t)]))
                if total + t in nearer:
                    old = nearer[total + t]
                    less = way[0] < old[0]
                    way = (np.where(less, way[0], old[0]), np.where(less, way[1], old[1]), np.where(less[:, None], way[2], old[2]))
                nearer[total + t] = way
        best = nearer
    _, expected, chosen = best[target]
    return chosen, expected


def linked(prints: DataFrame, radius: int = 2, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that join all fingerprints ``fp`` (distinct longs) at ``radius`` (0 or 2) or fewer differing bits.

    Every two such fingerprints are linked, directly or, where more than ``crowd`` candidates stand in the way, through
    others at the same distances.
    """
    if radius not in (0, 2):
        raise ValueError("the half-way search is exact for 0 and for 2 bits")
    rows = prints.count()
    groups = together(prints)
    widths = [len(group) for group in groups]
    index = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.expr(_value(bits)).alias("value")) for k, bits in enumerate(groups)])).alias("_x")).select("fp", "_x.part", "_x.value")
    sizes = index.groupBy("part", "value").agg((F.count("*") - 1).alias("others"))
    counted = index.join(sizes, ["part", "value"]).groupBy("fp").agg(*[F.max(F.when(F.col("part") == k, F.col("others"))).alias(f"n{k}") for k in range(len(groups))])

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for one in batches:
            if len(one):
                counts = one[[f"n{k}" for k in range(len(widths))]].to_numpy(np.float64)
                levels, expected = allocation(counts, widths, rows, radius)
                yield pd.DataFrame({"fp": one["fp"], "levels": list(levels), "crowded": expected > crowd})
        give_back()

    plan = settle(counted.mapInPandas(chosen, "fp long, levels array<long>, crowded boolean"), "simhash-plan")
    probes = None
    for k, bits in enumerate(groups):
        masks = F.when(F.col("_level") == 0, F.array(F.lit(0).cast("long")))
        for level in range(1, radius + 1):
            masks = masks.when(F.col("_level") == level, F.array(*[F.lit(x).cast("long") for x in _within(widths[k], level)]))
        own = plan.where("not crowded").select("fp", F.col("levels")[k].alias("_level")).where("_level >= 0")
        own = own.select("fp", F.lit(k).alias("part"), F.expr(_value(bits)).alias("_own"), F.explode(masks).alias("_mask"))
        own = own.select("fp", "part", F.col("_own").bitwiseXOR(F.col("_mask")).alias("value"))
        probes = own if probes is None else probes.union(own)
    other = index.select(F.col("fp").alias("b"), "part", "value")
    near = (
        probes.withColumnRenamed("fp", "a")
        .join(other, ["part", "value"])
        .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    flips = [0] + [1 << k if k < 63 else -(1 << 63) for k in range(BITS)] if radius == 2 else [0]
    halves = plan.where("crowded").select("fp", F.explode(F.array(*[F.lit(x).cast("long") for x in flips])).alias("_flip"))
    meets = halves.groupBy(F.col("fp").bitwiseXOR(F.col("_flip")).alias("_at")).agg(F.collect_set("fp").alias("_near")).where("size(_near) > 1")
    stars = meets.select(F.array_min("_near").alias("a"), F.explode("_near").alias("b")).where("a <> b")
    return near.union(stars)


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, radius: int = 2) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id``, the least key that links of ``radius`` bits reach.

    One row per row of ``docs``; nulls and empty texts have fingerprint zero and are linked like any other. A null key is
    in a class but never names one, unless the whole class has none. Other columns are left out.
    """
    spark = docs.sparkSession
    marks = settle(docs.select(F.col(key).alias("_id"), fingerprint(F.col(text), size)[0].alias("fp")), "simhash-marks")
    prints = settle(marks.groupBy("fp").agg(F.min("_id").alias("_least")), "simhash-prints")
    joined = settle(components(linked(prints.select("fp"), radius), "simhash"), "simhash-parts")
    tops = joined.join(prints, joined["node"] == prints["fp"]).groupBy("root").agg(F.min("_least").alias("_top"))
    named = joined.join(tops, "root").select(F.col("node").alias("fp"), "_top")
    of = settle(prints.join(named, "fp", "left").select("fp", F.coalesce("_top", "_least").alias("component_id")), "simhash-classes")
    return marks.join(of, "fp").select(
        F.col("_id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


#: Documents whose shingles are counted to put the frequent ones last; the order costs or saves work, never a pair.
SAMPLE = 10_000
#: Frequent shingles that are known to every task: 16 bytes each.
FREQUENT = 1 << 17
#: Bits that tell whose sets are needed, 1 MB; more keys than bits only mean that more sets are made.
NEEDED = 1 << 23


def hashed(text: str, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    from xxhash import xxh64_intdigest

    found = shingles(text, size)
    hashes = np.sort(np.fromiter((xxh64_intdigest(x, 42) for x in found), np.uint64, len(found)))
    return hashes[np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]].view(np.int64)


def shingle_set(text: Column, size: int = 5) -> Column:
    """The distinct shingle hashes of each text, sorted, as array<long>."""

    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([hashed(value, size) for held in pieces(texts) for value in held], dtype=object)
        give_back()

    return sets(text)


def sets_of(texts: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """``_id`` and ``_set``, as ``shingle_set`` has it, of the ``texts`` whose ``_id`` is ``needed``, and perhaps of a few others.

    No text is shuffled: texts are looked through where they lie, with a bit for each key that is needed.
    """
    spot = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(NEEDED)).alias("_spot")
    bits = needed.select(spot).groupBy(F.shiftright("_spot", 6).cast("int").alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_spot & 63 as int))")).alias("_bits")
    )
    flags = np.zeros(NEEDED >> 6, np.int64)
    known = bits.toPandas()
    flags[known["_word"].to_numpy(np.int64)] = known["_bits"].to_numpy(np.int64)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            spots = rows.column("_spot").to_numpy()
            rows = rows.take(pa.array(np.flatnonzero(flags[spots >> 6] >> (spots & 63) & 1)))
            at = 0
            for held in pieces(rows.column("_text").to_pylist()):
                sets = pa.array([hashed(value, size) for value in held], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column("_id").slice(at, len(held)), sets], names=["_id", "_set"])
                at += len(held)
        give_back()

    kind = texts.schema["_id"].dataType.simpleString()
    return texts.select("_id", "_text", spot).mapInArrow(made, f"_id {kind}, _set array<long>")


def frequent(texts: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample of ``SAMPLE`` texts, sorted, and how often each occurs there."""
    share = min(1.0, SAMPLE / max(1, texts.count()))
    some = texts.where(F.pmod(F.xxhash64(text), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    counts = some.select(F.explode(shingle_set(F.col(text), size)).alias("_token")).groupBy("_token").agg(F.count("*").alias("_n")).where("_n > 2")
    rows = sorted((token, n) for token, n in counts.orderBy(F.desc("_n"), "_token").limit(FREQUENT).collect())
    return np.array([token for token, _ in rows], np.int64), np.array([n for _, n in rows], np.int64)


def _least(share: float, n: int) -> int:
    """The least whole number that is ``share`` of n or more, rounding errors aside."""
    return int(np.ceil(share * n - 1e-9))


def prefixes(text: Column, size: int, similarity: float, known: tuple[np.ndarray, np.ndarray]) -> Column:
    """Of each text the size of its shingle set, ``many``, the shingles that a set as similar may share first in the common
    order, rare ones first, and how many of them, ``short``, do for partners that are as large or larger."""
    tokens, often = known

    @F.pandas_udf("many int, short int, first array<long>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for held in pieces(texts):
                for value in held:
                    own = hashed(value, size)
                    if len(tokens) and len(own):
                        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                        own = own[np.argsort(np.where(tokens[at] == own, often[at], 0), kind="stable")]
                    n = len(own)
                    out.append((n, n - _least(2 * similarity / (1 + similarity), n) + 1, own[: n - _least(similarity, n) + 1]))
            yield pd.DataFrame(out, columns=["many", "short", "first"])
        give_back()

    return cut(text)


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows (id, root) of documents that have near copies: ``root`` is the least key of the group.

    Documents are near if the Jaccard similarity of their sets of ``size``-word shingles is ``similarity`` or more, or if
    their texts are equal; groups are the exact components. The first shingle in common of two such sets lies in the
    prefix of both, so all candidates meet under it. Every document is compared with the least one under each of its
    shingles; then the documents of a shingle that aren't in its largest group yet are compared with all of other groups
    there. Who is in a group already needs no comparison within it, so a group of any size makes rows in proportion.
    Null keys aren't judged.
    """
    spark = docs.sparkSession
    given = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    marks = settle(given.select("_id", F.md5("_text").alias("_same")), "near-marks")
    same = settle(marks.join(marks.groupBy("_same").agg(F.min("_id").alias("_first")), "_same").select("_id", "_first"), "near-same")
    copies = same.where("_id <> _first").select(F.col("_first").alias("a"), F.col("_id").alias("b"))
    # Texts stay where they are: only keys are left out, those that name copies alone and, but once, those of several rows.
    away = settle(copies.select(F.col("b").alias("_id")).distinct().join(same.where("_id = _first"), "_id", "left_anti"), "near-away")
    texts = given.join(away, "_id", "left_anti")
    again = settle(same.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").select("_id"), "near-again")
    if not again.isEmpty():
        once = texts.join(again, "_id", "left_semi").groupBy("_id").agg(F.min("_text").alias("_text"))
        texts = texts.join(again, "_id", "left_anti").unionByName(once)

    def met_under() -> DataFrame:
        """Rows of the shingles that several documents may share first, and the least document there."""
        # No filter on what Python gives: pushed below, it would have Python work twice. Empty prefixes make no rows.
        cut = texts.select("_id", prefixes(F.col("_text"), size, similarity, frequent(texts, "_text", size)).alias("_p"))
        rows = cut.select("_id", F.col("_p.many").alias("_many"), F.col("_p.short").alias("_short"), F.posexplode("_p.first").alias("_at", "_token"))
        rows = settle(rows, "near-prefixes")
        ends = rows.groupBy("_token").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high")).where("_low <> _high")
        return rows.join(ends.select("_token", "_low"), "_token")

    shared = settle_alone(spark, met_under, "near-shared")

    def alike(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose sets are similar."""
        return settle_alone(spark, lambda: _alike(pairs, name), f"{name}-links")

    def _alike(pairs: DataFrame, name: str) -> DataFrame:
        pairs = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-candidates")
        needed = pairs.select(F.col("a").alias("_id")).union(pairs.select(F.col("b").alias("_id"))).distinct()
        sets = settle(sets_of(texts, needed, size), f"{name}-sets")
        one, two = sets.select(F.col("_id").alias("a"), F.col("_set").alias("_sa")), sets.select(F.col("_id").alias("b"), F.col("_set").alias("_sb"))
        both = F.size(F.array_intersect("_sa", "_sb"))
        near = both >= F.lit(similarity) * (F.size("_sa") + F.size("_sb") - both) - 1e-9
        return pairs.join(one, "a").join(two, "b").where(near).select("a", "b")

    def side(name: str) -> DataFrame:
        return placed.select("_token", *[F.col(x).alias(x + name) for x in ("_id", "_many", "_short", "_at", "_root")])

    def fits(a: str, b: str) -> Column:
        """Whether sets of such sizes whose first common shingle is at such places can be similar."""
        many, other = F.col("_many" + a), F.col("_many" + b)
        in_short = F.when(many <= other, F.col("_at" + a) < F.col("_short" + a)).otherwise(F.col("_at" + b) < F.col("_short" + b))
        most = F.least(many - F.col("_at" + a), other - F.col("_at" + b))
        return in_short & (most >= F.lit(similarity / (1 + similarity)) * (many + other) - 1e-9) & (F.least(many, other) >= F.lit(similarity) * F.greatest(many, other) - 1e-9)

    low = shared.where("_id = _low").select("_token", *[F.col(x).alias(x + "b") for x in ("_id", "_many", "_short", "_at")])
    first = shared.select("_token", *[F.col(x).alias(x + "a") for x in ("_id", "_many", "_short", "_at")])
    met = first.join(low, "_token").where((F.col("_ida") != F.col("_idb")) & fits("a", "b"))
    links = alike(met.select(F.col("_ida").alias("a"), F.col("_idb").alias("b")), "near-first")
    roots = components(links, "near-first").select(F.col("node").alias("_id"), F.col("root").alias("_root"))
    placed = settle(shared.join(roots, "_id", "left").withColumn("_root", F.coalesce("_root", "_id")), "near-placed")
    sizes = placed.groupBy("_token", "_root").agg(F.count("*").alias("_n"))
    top = sizes.groupBy("_token").agg(F.max(F.struct("_n", "_root"))["_root"].alias("_top"), F.count("*").alias("_roots")).where("_roots > 1")
    left = side("a").join(top.select("_token", "_top"), "_token").where("_roota <> _top")
    # Similar sets share many of their first shingles, not one: those that share fewer are never compared.
    a, b = F.col("_manya"), F.col("_manyb")
    overlap = F.ceil(F.lit(similarity / (1 + similarity)) * (a + b) - 1e-9)
    needed = overlap + 1 - F.ceil(F.lit(similarity) * F.greatest(a, b) - 1e-9)
    # Where neither of two is in the largest group of a shingle, it would bring them twice.
    once = (F.col("_rootb") == F.col("_top")) | (F.col("_ida") < F.col("_idb"))
    sizes_fit = F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9
    more = left.join(side("b"), "_token").where((F.col("_roota") != F.col("_rootb")) & once & sizes_fit)
    more = more.select(F.least("_ida", "_idb").alias("a"), F.greatest("_ida", "_idb").alias("b"), needed.alias("_needed"), fits("a", "b").alias("_fits"))
    more = more.groupBy("a", "b", "_needed").agg(F.count("*").alias("_shared"), F.max("_fits").alias("_fits"))
    rest = alike(more.where("_fits and _shared >= _needed").select("a", "b"), "near-rest")
    return components(links.union(rest).union(copies), "near").select(F.col("node").alias("_id"), F.col("root").alias("_root"))


def without_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """``docs`` with one document, that of the least key, of each class of linked fingerprints (``classes``), and of what these
    keep, one of each group of near copies (``near_groups``), which lie beyond the radius of fingerprints.

    Columns stay as they are. Rows that repeat a key and its text are one document, the first met stays. A key that several
    unlike texts share names none of them: these rows aren't judged, and one of each text stays. Rows without a key stay.
    A null text counts as empty.
    """
    spark = docs.sparkSession
    (name,) = unused(docs.columns, "_gone")
    keyed = docs.where(F.col(key).isNotNull())
    same = F.md5(F.coalesce(F.col(text), F.lit("")))
    many = keyed.groupBy(F.col(key).alias(name)).agg(F.count("*").alias("_many"), F.min(same).alias("_least"), F.max(same).alias("_most"))
    many = settle(many.where("_many > 1").select(name, (F.col("_least") != F.col("_most")).alias("_unlike")), "near-shared-keys")
    rest = docs.where(F.col(key).isNull())
    own = keyed
    if not many.isEmpty():
        named = F.col(key) == F.col(name)
        once = keyed.join(many.where("not _unlike"), named, "left_semi").dropDuplicates([key])
        own = keyed.join(many, named, "left_anti").unionByName(once)
        unlike = keyed.join(many.where("_unlike"), named, "left_semi").withColumn(name, same).dropDuplicates([key, name]).drop(name)
        rest = rest.unionByName(unlike)

    def without(rows: DataFrame, keys: Callable[[], DataFrame], of: str) -> DataFrame:
        return rows.join(settle_alone(spark, lambda: keys().distinct(), of), F.col(key) == F.col(name), "left_anti")

    # Only keys are written; texts are read where they lie.
    kept = without(own, lambda: classes(own, text, key).where(F.col(key) != F.col("component_id")).select(F.col(key).alias(name)), "near-linked")
    kept = without(kept, lambda: near_groups(kept, text, key, **how).where("_id <> _root").select(F.col("_id").alias(name)), "near-gone")
    return kept.unionByName(rest)
