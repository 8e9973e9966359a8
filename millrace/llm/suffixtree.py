"""Language-model scores by a probabilistic suffix tree over words, grown from its root over the whole corpus.

A context is the last k words before a token. It becomes a state of the tree if the state of its last k - 1 words is one, and
if the tokens after it diverge enough from those after that shorter context (``divergence``). A state's next-token
distribution is smoothed with its shorter context's, down to the root, whose distribution is that of single tokens:

    P(w | s) = (c(s, w) + T(s) P(w | shorter)) / (N(s) + T(s)),     P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

with T(s) the number of different tokens seen after s. A token is scored in the longest state that its history ends with.

Neither the corpus nor the tree is ever in one place. Texts become *blocks* of hashed tokens once. For each length of
contexts, blocks send their distinct n-grams and counts (sorted, by slices of the hash range) to the slices' tasks, which add
them up and answer each block in its own order; then the same with what each context's divergence is made of. A key that
many documents share is one entry per block, so it makes no task larger. Positions whose context is no state, or whose next
longer one occurs only once, are scored and leave. Blocks are a table bucketed by their number: answers come to them.

Words and contexts are told apart by 64-bit hashes (words of one length up to eight bytes never clash). Among n different
ones some n^2 / 2^64 pairs share a number and have their counts added together: none to be expected below 10^9.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fold_of, give_back, unused
from millrace.session import fresh_path, release

#: Longest context, and the least divergence of a state from its shorter context, in nats over all its tokens.
DEPTH, DIVERGENCE = 3, 3.0
#: Tokens of a block (a longer document is a block of its own), and of a slice of the hash range.
BLOCK, SLICE = 1 << 20, 1 << 21
HALF = 0.5
#: Bytes of a token, about, and the most buckets a table can have; more blocks than that share buckets.
TOKEN_BYTES, BUCKETS = 6, 100_000

ONE = np.uint64(1)
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


#: The token that ends every document: no word has its length.
END = mixed(np.array([0], np.uint64) * C1)[0]


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of texts that lie one behind the other, A-Z lower-cased, and the number of tokens of each."""
    rows = len(offsets) - 1
    lowered = np.zeros(len(data) + 8, np.uint8)
    lowered[:-8] = data | (((data >= 65) & (data <= 90)).view(np.uint8) << 5)
    inside = np.ones(len(data) + 1, bool)
    inside[:-1] = (data != 32) & ((data < 9) | (data > 13))
    inside[-1] = False
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(inside[:-1] & (border[:-1] | ~np.append(False, inside[:-2]))) if len(data) else np.zeros(0, np.int64)
    stops = np.flatnonzero(inside[:-1] & (border[1:] | ~inside[1:])) + 1
    sizes = stops - starts
    hashes = mixed(sizes.astype(np.uint64) * C1)
    eight = np.ndarray((len(data) + 1,), "<u8", lowered, 0, (1,))
    left = np.arange(len(starts))
    for step in range(0, int(sizes.max(initial=0)), 8):
        if step:
            left = left[sizes[left] > step]
        chunk = eight[starts[left] + step]
        short = np.minimum(sizes[left] - step, 8).astype(np.uint64)
        chunk &= np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - short) << np.uint64(3))
        hashes[left] = mixed(hashes[left] ^ chunk)
    words = np.diff(np.searchsorted(starts, offsets))
    out = np.full(len(starts) + rows, END)
    out[np.arange(len(starts)) + np.repeat(np.arange(rows), words)] = hashes
    return out, words + 1


def squeezed(values: np.ndarray) -> bytes:
    """Numbers, byte plane by byte plane, compressed; unsigned ones in the least type that holds them."""
    if values.dtype.kind == "u" and values.size:
        values = values.astype(np.min_scalar_type(values.max()))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    body = pa.compress(planes.tobytes(), codec="zstd", asbytes=True)
    return values.dtype.str.encode().ljust(4) + len(values).to_bytes(8, "little") + body


def expanded(packed: bytes) -> np.ndarray:
    kind, size = np.dtype(packed[:4].decode().strip()), int.from_bytes(packed[4:12], "little")
    planes = pa.decompress(packed[12:], decompressed_size=size * kind.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, size).T).reshape(-1).view(kind)


def squeezed_rising(values: np.ndarray) -> bytes:
    """The same for rising numbers from 0 on, by their steps."""
    return squeezed(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def expanded_rising(packed: bytes) -> np.ndarray:
    return np.cumsum(expanded(packed), dtype=np.uint64)


STATE = "block bigint, ids array<{key}>, held array<boolean>, sizes array<int>, known array<bigint>, base array<double>, score array<double>, words binary, tokens binary, places binary, seen array<binary>, n bigint, teaching bigint, open bigint"


def blocks(docs: DataFrame, text: str, key: str, held_out: tuple[int, int]) -> DataFrame:
    """Documents as blocks: ids, whether held out, numbers of tokens, and the tokens as numbers of the block's own words."""
    key_type = docs.schema[key].dataType.simpleString()
    folds, out = held_out
    held = F.coalesce(fold_of(key, folds) == out, F.lit(False))
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(key).alias("id"), held.alias("held"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        parts: list[tuple] = []
        gathered = 0

        def block() -> pa.RecordBatch:
            hashes = np.concatenate([part[0] for part in parts])
            sizes = np.concatenate([part[1] for part in parts])
            ids = pa.chunked_array([part[2] for part in parts]).combine_chunks()
            apart = pa.chunked_array([part[3] for part in parts]).combine_chunks()
            words, tokens = np.unique(hashes, return_inverse=True)
            teaching = int(sizes[~apart.to_numpy(zero_copy_only=False)].sum())
            whole = np.array([0, len(sizes)], np.int32)
            nothing = pa.ListArray.from_arrays(whole, pa.array(np.zeros(len(sizes))))
            columns = {
                "block": pa.array([number], pa.int64()),
                "ids": pa.ListArray.from_arrays(whole, ids),
                "held": pa.ListArray.from_arrays(whole, apart),
                "sizes": pa.ListArray.from_arrays(whole, pa.array(sizes.astype(np.int32))),
                "known": pa.ListArray.from_arrays(whole, pa.array(np.zeros(len(sizes), np.int64))),
                "base": nothing,
                "score": nothing,
                "words": pa.array([squeezed_rising(words)], pa.binary()),
                "tokens": pa.array([squeezed(tokens.astype(np.uint32))], pa.binary()),
                "places": pa.nulls(1, pa.binary()),
                "seen": pa.array([[]], pa.list_(pa.binary())),
                "n": pa.array([len(hashes)], pa.int64()),
                "teaching": pa.array([teaching], pa.int64()),
                "open": pa.array([len(hashes)], pa.int64()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            texts = batch.column(0).cast(pa.large_string())
            _, offsets, data = texts.buffers()
            offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            first = 0
            while first < len(texts):
                # Some rows at a time, so that what is worked out per byte stays small.
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + 4 * BLOCK, "right")) - 1)
                some = offsets[first : last + 1]
                bytes_ = np.frombuffer(data, np.uint8)[some[0] : some[-1]] if data is not None else np.zeros(0, np.uint8)
                hashes, sizes = token_hashes(bytes_, some - some[0])
                if gathered and gathered + len(hashes) > BLOCK:
                    yield block()
                    parts, gathered, number = [], 0, number + 1
                parts.append((hashes, sizes, batch.column(1).slice(first, last - first), batch.column(2).slice(first, last - first)))
                gathered += len(hashes)
                first = last
        if parts:
            yield block()
        parts.clear()
        give_back()

    return rows.mapInArrow(build, STATE.format(key=key_type))


class Positions:
    """What a block knows about its open tokens and their contexts of ``level`` words.

    ``seen`` has what the levels before have answered: counts of the block's words and, as contexts, their occurrences and
    different followers (zeros: no state), then each open token's count; of longer contexts all three by open token.
    """

    def __init__(self, state: dict, level: int, contexts: bool = True, grams: bool = True):
        self.words, tokens = expanded_rising(state["words"]), expanded(state["tokens"])
        sizes = np.asarray(state["sizes"], np.int64)
        ends = np.cumsum(sizes)
        if state["places"] is None:
            # The first token of a document has no context.
            first = np.zeros(len(tokens), bool)
            first[ends - sizes] = True
            self.places = np.flatnonzero(~first)
        else:
            self.places = expanded_rising(state["places"]).astype(np.int64)
        self.level, self.tokens, self.sizes, self.begins = level, tokens, sizes, ends - sizes
        self.seen = [expanded(x) for x in state.get("seen") or []]
        self.doc = np.searchsorted(ends, self.places, "right")
        self.teaches = ~np.asarray(state["held"], bool)[self.doc] if len(sizes) else np.zeros(0, bool)
        before = tokens[self.places - 1]
        context = self.words[before]
        for k in range(2, level + 1):
            context = mixed(context * C1 + self.words[tokens[self.places - k]])
        # The lowest bit of an n-gram's number is free.
        self.gram = mixed(context * C3 + self.words[tokens[self.places]]) & ~ONE if grams else None
        if contexts:
            # Contexts of one word are the block's words themselves.
            self.contexts, self.of_context = (self.words, before) if level == 1 else np.unique(context, return_inverse=True)

    def shorter_chance(self, totals: tuple[int, int]) -> np.ndarray:
        """Each open token's chance after the context one word shorter."""
        chance = _root(self.seen[0], totals)[self.tokens[self.places]]
        if self.level > 1:
            before = self.tokens[self.places - 1]
            chance = smoothed(self.seen[3], self.seen[1][before], self.seen[2][before], chance)
        for k in range(2, self.level):
            n, different, counts = self.seen[3 * k - 2 : 3 * k + 1]
            chance = smoothed(counts, n, different, chance)
        return chance

    def gram_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams, rising, and how often each occurs where it teaches: the lowest bit, once they are sorted."""
        marked = np.sort(self.gram | self.teaches)
        grams = marked & ~ONE
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
        return grams[first], np.add.reduceat(marked & ONE, first) if len(first) else first.astype(np.uint64)

    def word_counts(self, held: list[bool]) -> np.ndarray:
        teaches = np.repeat(~np.asarray(held, bool), self.sizes)
        return np.bincount(self.tokens, teaches, len(self.words)).astype(np.uint32)


def smoothed(counts: np.ndarray, n: np.ndarray, different: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Chance after a state, from that after its shorter context."""
    different = different.astype(float)
    return (counts + different * shorter) / (n + different)


REQUEST = "kind string, slice int, block bigint, keys binary, values array<binary>"
ANSWER = "kind string, slice int, block bigint, values array<binary>, different bigint"


def sliced(kind: str, block: int, keys: np.ndarray, values: list[np.ndarray], bits: int) -> Iterator[dict]:
    """Rising keys and what goes with them, as a request to each slice of the hash range that they touch."""
    edges = [0, *np.searchsorted(keys, (np.arange(1, 1 << bits, dtype=np.uint64)) << np.uint64(64 - bits)).tolist(), len(keys)] if bits else [0, len(keys)]
    for number, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b > a:
            yield {"kind": kind, "slice": number, "block": block, "keys": squeezed_rising(keys[a:b]), "values": [squeezed(x[a:b]) for x in values]}


def _request_rows(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("kind", pa.string()), ("slice", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("values", pa.list_(pa.binary()))])
    return pa.RecordBatch.from_pylist(rows, schema)


def count_requests(state: DataFrame, level: int, bits: int) -> DataFrame:
    """Each block's distinct n-grams of ``level`` + 1 tokens, with their counts in documents that teach; first the words, too."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                own = Positions(row, level, contexts=False)
                grams, counts = own.gram_counts()
                yield _request_rows(list(sliced("grams", row["block"], grams, [counts], bits)))
                if level == 1:
                    yield _request_rows(list(sliced("words", row["block"], own.words, [own.word_counts(row["held"])], bits)))
        give_back()

    return state.select("block", "held", "sizes", "words", "tokens", "places").mapInArrow(ask, REQUEST)


def _added(requests: pa.Table) -> tuple[list[int], list[int], np.ndarray, list[np.ndarray], np.ndarray]:
    """Requests to a slice put together: blocks, their numbers of keys, sums over equal keys, and the sum of each key."""
    requests = requests.sort_by("block")
    keys = [expanded_rising(x) for x in requests["keys"].to_pylist()]
    values = [[expanded(y) for y in x] for x in requests["values"].to_pylist()]
    sizes = [len(x) for x in keys]
    _, of = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(of, np.concatenate([x[k] for x in values]).astype(float)) for k in range(len(values[0]))]
    return requests["block"].to_pylist(), sizes, of, sums, np.cumsum([0, *sizes])


def _answers(requests: pa.Table, blocks_: list[int], values: list[np.ndarray], edges: np.ndarray, different: int) -> pa.Table:
    many = len(blocks_)
    return pa.table(
        {
            "kind": pa.array([requests["kind"][0].as_py()] * many, pa.string()),
            "slice": pa.array([requests["slice"][0].as_py()] * many, pa.int32()),
            "block": pa.array(blocks_, pa.int64()),
            "values": pa.array([[squeezed(x[a:b]) for x in values] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.list_(pa.binary())),
            "different": pa.array([different, *[0] * (many - 1)], pa.int64()),
        }
    )


def counted(requests: DataFrame) -> DataFrame:
    """The whole corpus' count of each key asked for, in the order of the asking block; how many keys have one."""

    def add(some: pa.Table) -> pa.Table:
        asking, _, of, (totals,), edges = _added(some)
        return _answers(some, asking, [totals.astype(np.uint64)[of]], edges, int((totals > 0).sum()))

    return requests.groupBy("kind", "slice").applyInArrow(add, ANSWER)


def divergence(n: np.ndarray, single: np.ndarray, different: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """How far the tokens after a context diverge from those after the shorter one: the sum over its tokens of the log ratio
    of their chances, each token left out of the counts that its own chance is taken from.

    A token seen c > 1 times after the context counts by (c - 1) / (n + T - 1), less than its smoothed chance; one seen
    once by (T - 1) / (n + T - 2) times its chance after the shorter context. ``ratios``: the sum of log((c - 1) / chance
    after the shorter context) over tokens seen more than once; ``single``: the number of those seen once.
    """
    rest = np.maximum(different - 1, 1)
    return ratios - (n - single) * np.log(np.maximum(n + different - 1, 1)) + single * np.log(rest / np.maximum(n + different - 2, 1))


def judged(requests: DataFrame, least: float) -> DataFrame:
    """For each context asked about: occurrences and different tokens after it; zeros if it becomes no state. Notes go back to
    their blocks as they are."""

    def judge(some: pa.Table) -> pa.Table:
        if some["kind"][0].as_py() == "own":
            return some.drop_columns(["keys"]).append_column("different", pa.array([0] * len(some), pa.int64()))
        asking, _, of, (n, single, parts, ratios), edges = _added(some)
        different = single + np.rint(parts)  # a token seen c times is a c-th part of a token each time
        state = (n >= 2) & (divergence(n, single, different, ratios) >= least)
        values = [np.where(state, x, 0).astype(np.uint64)[of] for x in (n, different)]
        return _answers(some, asking, values, edges, int(state.sum()))

    return requests.groupBy("kind", "slice").applyInArrow(judge, ANSWER)


def _gathered(answers: pa.Table, kind: str, part: int = 0) -> np.ndarray:
    """A block's answers of a kind, in the order of its keys."""
    rows = sorted((s, v) for k, s, v in zip(answers["kind"].to_pylist(), answers["slice"].to_pylist(), answers["values"].to_pylist(), strict=True) if k == kind)
    return np.concatenate([np.zeros(0, np.uint64), *(expanded(v[part]) for _, v in rows)])


def _root(counts: np.ndarray, totals: tuple[int, int]) -> np.ndarray:
    """Chance of each word at the root; ``totals``: tokens and different tokens that teach."""
    return (counts + HALF) / (totals[0] + HALF * (totals[1] + 1))


def divergence_requests(state: DataFrame, answers: DataFrame, level: int, bits: int, totals: tuple[int, int]) -> DataFrame:
    """What each block adds to the divergence of its contexts; and, in a slice of its own, what it has been answered, as a note
    to itself: its tokens' counts, the words' first where contexts have one word."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        own = Positions(row, level)
        _, of_gram = np.unique(own.gram, return_inverse=True)
        whole = _gathered(right, "grams")[of_gram]
        if level == 1:
            own.seen = [_gathered(right, "words")]
        note = [*(own.seen[:1] if level == 1 else []), whole]
        kept = {"kind": "own", "slice": hash(row["block"]) & 0x7FFFFFFF, "block": row["block"], "keys": b"", "values": [squeezed(x) for x in note]}
        counts = whole[own.teaches].astype(float)
        context, shorter = own.of_context[own.teaches], own.shorter_chance(totals)[own.teaches]
        often = counts > 1
        many = len(own.contexts)
        values = [
            np.bincount(context, minlength=many).astype(np.uint32),
            np.bincount(context[~often], minlength=many).astype(np.uint32),
            np.bincount(context[often], 1 / counts[often], many),
            np.bincount(context[often], np.log((counts[often] - 1) / shorter[often]), many).astype(np.float32),
        ]
        keys = own.contexts
        if level == 1:  # words that occur once become no state
            asked = own.seen[0] >= 2
            keys, values = keys[asked], [x[asked] for x in values]
        out = pa.Table.from_batches([_request_rows([kept, *sliced("contexts", row["block"], keys, values, bits)])])
        del own, counts, context, shorter, often, values, keys, whole
        give_back()
        return out

    inputs = state.select("block", "held", "sizes", "words", "tokens", "places", "seen")
    return inputs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, REQUEST)


def advanced(state: DataFrame, answers: DataFrame, level: int, totals: tuple[int, int], depth: int) -> DataFrame:
    """Blocks after contexts of ``level`` words: tokens whose context is a state stay open for longer contexts; all others are
    added to their documents' scores."""

    def advance(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        own = Positions(row, level, grams=False)
        known, base, score = (np.asarray(row[name]) for name in ("known", "base", "score"))
        docs = len(own.sizes)
        asked = np.ones(len(own.contexts), bool)
        if level == 1:
            own.seen = [_gathered(right, "own")]
            chances = _root(own.seen[0], totals)[own.tokens]
            doc = np.repeat(np.arange(docs), own.sizes)
            known = np.bincount(doc, own.seen[0][own.tokens] > 0, docs).astype(np.int64)
            base = np.bincount(doc, np.log10(chances), docs)
            score = np.log10(chances[own.begins])
            asked = own.seen[0] >= 2
        n, different = (np.zeros(len(own.contexts), np.uint64) for _ in range(2))
        n[asked], different[asked] = _gathered(right, "contexts", 0), _gathered(right, "contexts", 1)
        counts = _gathered(right, "own", -1)
        chance = own.shorter_chance(totals)
        state_ = n[own.of_context] > 0
        inside = own.of_context[state_]
        chance[state_] = smoothed(counts[state_], n[inside], different[inside], chance[state_])
        stay = state_ & (own.places - own.begins[own.doc] > level) & (level < depth)
        # The next longer context is what ends before the token: where that is known to occur once, it is no state.
        before = np.searchsorted(own.places, own.places - 1)
        once = (own.places[before] == own.places - 1) & (counts[before] < 2) if len(before) else np.zeros(0, bool)
        stay &= ~once
        score = score + np.bincount(own.doc[~stay], np.log10(chance[~stay]), docs)
        places = own.places[stay]
        # Only the tokens that longer contexts may still need go on.
        needed = np.zeros(len(own.tokens), bool)
        for k in range(depth + 1):
            needed[np.maximum(places - k, 0)] = True
        used = np.zeros(len(own.words), bool)
        used[own.tokens[needed]] = True
        tokens = np.where(needed, (np.cumsum(used) - 1)[own.tokens], 0).astype(np.uint32)
        used = np.flatnonzero(used)
        if level == 1:
            seen = [own.seen[0][used], n[used], different[used], counts[stay]]
        else:
            inside = own.of_context[stay]
            seen = [*(x[used] for x in own.seen[:3]), *(x[stay] for x in own.seen[3:]), n[inside], different[inside], counts[stay]]
        made = {
            **{name: left[name] for name in ("block", "ids", "held", "sizes")},
            "known": pa.array([known.tolist()], pa.list_(pa.int64())),
            "base": pa.array([base.tolist()], pa.list_(pa.float64())),
            "score": pa.array([score.tolist()], pa.list_(pa.float64())),
            "words": pa.array([squeezed_rising(own.words[used])], pa.binary()),
            "tokens": pa.array([squeezed(tokens)], pa.binary()),
            "places": pa.array([squeezed_rising(places)], pa.binary()),
            "seen": pa.array([[squeezed(x) for x in seen]], pa.list_(pa.binary())),
            "n": left["n"],
            "teaching": left["teaching"],
            "open": pa.array([len(places)], pa.int64()),
        }
        del own, counts, chance, stay, state_, inside, seen, tokens, needed, before
        give_back()
        return pa.table(made)

    return state.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(advance, state.schema)


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _bucketed(df: DataFrame, buckets: int) -> tuple[DataFrame, str, str]:
    """Blocks as a table in the shared folder whose buckets need no shuffle to meet their answers; its name and folder."""
    path, name = fresh_path(df.sparkSession, "lm-blocks"), f"millrace_blocks_{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(buckets, "block").option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name), path, name


def _let_go(spark: SparkSession, *paths: str) -> None:
    """Intermediate results go, and with them the shuffle files of what has ended: these wait for the driver's garbage to be
    collected, which a large heap may put off for longer than their disk lasts, so it is asked for. Spark holds on to the job
    that it ran last, so a small one comes before."""
    release(spark, *paths)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def grown(docs: DataFrame, text: str, key: str, held_out: tuple[int, int], depth: int, least: float) -> tuple[DataFrame, int]:
    """Blocks with all their scores, and the number of tokens that teach."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text) + TOKEN_BYTES)).first()[0] or 0
    # With fewer buckets than a shuffle has partitions, Spark would deal the blocks anew.
    buckets = min(BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (TOKEN_BYTES * BLOCK)))
    state, path, name = _bucketed(blocks(docs, text, key, held_out), buckets)
    tokens, teaching = (int(x or 0) for x in state.agg(F.sum("n"), F.sum("teaching")).first())
    bits = max(0, (tokens // SLICE).bit_length())
    totals = (teaching, 0)
    for level in range(1, depth + 1):
        answers, counts_path = _written(counted(count_requests(state, level, bits)), "lm-counts")
        seen = {row["kind"]: row["n"] for row in answers.groupBy("kind").agg(F.sum("different").alias("n")).collect()}
        totals = (teaching, int(seen.get("words", totals[1])))
        _let_go(spark)
        asked = divergence_requests(state, answers, level, bits, totals)
        judgements, contexts_path = _written(judged(asked, least), "lm-contexts")
        judgements.agg(F.sum("different")).first()
        _let_go(spark, counts_path)
        following = advanced(state, judgements, level, totals, depth)
        old, old_path = name, path
        state, path, name = _bucketed(following, buckets)
        spark.sql(f"DROP TABLE {old}")
        left = state.agg(F.sum("open")).first()[0]
        _let_go(spark, old_path, contexts_path)
        if not left:
            break
    whole = spark.read.schema(state.schema).parquet(path)
    spark.sql(f"DROP TABLE {name}")
    return whole, teaching


def scored(
    docs: DataFrame, text: str = "text", key: str = "doc_id", held_out: tuple[int, int] = (5, 1), depth: int = DEPTH, least: float = DIVERGENCE
) -> DataFrame:
    """A row for each row of ``docs``: ``key``, ``held_out``, ``n_tokens``, ``n_known`` (tokens that teaching documents have),
    ``train_tokens``, ``base_score`` (log10 chance at the root alone) and ``score`` (log10 chance in the tree).

    Documents of the fold ``held_out`` (folds, fold) are scored but teach nothing; a null key is of no fold and teaches. Null
    counts as empty, and an empty text has one token, its end. Texts are read whole, however long. Rows that repeat teach
    and are scored as often as they are there. Without documents that teach, every token has chance 1 at the root. An
    empty table gives no rows. Columns beside ``key`` and ``text`` aren't read, whatever their names.
    """
    if depth < 1:
        raise ValueError(f"contexts have one word at least: {depth}")
    state, teaching = grown(docs, text, key, held_out, depth, least)
    own = unused([key], "_row")[0]
    zipped = F.arrays_zip("ids", "held", "sizes", "known", "base", "score")
    return state.select(F.explode(zipped).alias(own)).select(
        F.col(own)["ids"].alias(key),
        F.col(own)["held"].alias("held_out"),
        F.col(own)["sizes"].cast("bigint").alias("n_tokens"),
        F.col(own)["known"].alias("n_known"),
        F.lit(teaching).cast("bigint").alias("train_tokens"),
        F.col(own)["base"].alias("base_score"),
        F.col(own)["score"].alias("score"),
    )
