"""Fill-in-the-middle: a text is cut at two unit borders and its parts are put in another order.

Units (lines, or characters) are found in the UTF-8 bytes of a whole batch, eight at a time: the bytes are viewed as 64-bit
words, the bytes that end a unit are marked by arithmetic on the words, marks are counted per word and summed up, the word
that holds a wanted mark is searched in the sums, and the mark itself is selected inside its word. Only the places of the
cuts come from Python; texts are cut and put together by native functions, whatever their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import unused

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LOW7, HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
NEWLINES = np.uint64(0x0A0A0A0A0A0A0A0A)
ONE = np.uint64(1)
UNITS = ("lines", "characters")


def as_words(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian words of 64 bits, filled up with zeros, and a word of zeros behind."""
    padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def newline_marks(words: np.ndarray) -> np.ndarray:
    """The highest bit of every byte that is a line feed; no carry leaves a byte, so neighbours can't disturb it."""
    odd = words ^ NEWLINES
    return ~(((odd & LOW7) + LOW7) | odd | LOW7)


def character_marks(words: np.ndarray) -> np.ndarray:
    """The highest bit of every byte that begins a character: any but 10xxxxxx."""
    return (~words | (words << ONE)) & HIGH


class Marks:
    """Marked bytes of a run of words, with their counts summed up."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.cumsum(np.bitwise_count(marks), dtype=np.int64)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Marks before each byte place."""
        word = places >> 3
        below = (ONE << ((places & 7).astype(np.uint64) << np.uint64(3))) - ONE
        own = np.bitwise_count(self.marks[word] & below).astype(np.int64)
        return np.where(word > 0, self.upto[np.maximum(word, 1) - 1], 0) + own

    def select(self, numbers: np.ndarray) -> np.ndarray:
        """The place of each mark by its number, from 1 on."""
        word = np.searchsorted(self.upto, numbers, side="left")
        left = numbers - np.where(word > 0, self.upto[np.maximum(word, 1) - 1], 0)
        held = self.marks[word]
        for step in range(1, 8):  # at most seven marks of a word come before the wanted one
            held = np.where(left > step, held & (held - ONE), held)
        lowest = held & (~held + ONE)
        return (word << 3) + (np.bitwise_count(lowest - ONE).astype(np.int64) >> 3)


def cut_places(data: np.ndarray, offsets: np.ndarray, one: np.ndarray, other: np.ndarray, units: str) -> dict[str, np.ndarray]:
    """For texts that lie one behind the other in ``data``: units of each, bytes before either cut, characters before and
    between the cuts. A text of n units is cut after ``one % (n + 1)`` and ``other % (n + 1)`` of them."""
    begin, end = offsets[:-1], offsets[1:]
    words = as_words(data)
    starts = character_marks(words)
    if units == "lines":
        ends = Marks(newline_marks(words))
        # The last line of a text may have no line feed.
        closing = np.where(end > begin, data[np.maximum(end, 1) - 1] != 10, False) if len(data) else np.zeros(len(begin), bool)
    else:
        # A byte ends a character if the next one begins one.
        ends = Marks((starts >> np.uint64(8)) | (np.append(starts[1:], np.uint64(0)) << np.uint64(56)))
        closing = np.zeros(len(begin), bool)
    before = ends.rank(begin)
    marked = ends.rank(end) - before
    n = marked + closing
    a, b = one % (n + 1), other % (n + 1)

    def place(k: np.ndarray) -> np.ndarray:
        inside = (k > 0) & (k <= marked)
        found = ends.select(np.where(inside, before + k, 1)) + 1 if inside.any() else begin
        return np.where(k == 0, begin, np.where(inside, found, end))

    first, second = place(np.minimum(a, b)), place(np.maximum(a, b))
    characters = Marks(starts)
    at = characters.rank(first)
    return {
        "n": n,
        "first": first - begin,
        "second": second - begin,
        "prefix_chars": at - characters.rank(begin),
        "middle_chars": characters.rank(second) - at,
    }


CUTS = "struct<n: bigint, first: bigint, second: bigint, prefix_chars: bigint, middle_chars: bigint>"


def cuts(text: Column, one: Column, other: Column, units: str = "lines") -> Column:
    """``cut_places`` of each text (not null), by two unsigned numbers."""
    if units not in UNITS:
        raise ValueError(f"units are one of {UNITS}: {units!r}")

    @F.arrow_udf(CUTS)
    def places(texts: pa.Array, ones: pa.Array, others: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        found = cut_places(data, offsets - offsets[0], *(x.cast(pa.int64()).to_numpy(zero_copy_only=False) for x in (ones, others)), units)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found.values()], names=list(found))

    return places(text, one, other)


def draws(key: Column, seed: int = 7) -> list[Column]:
    """Four unsigned numbers of 32 bits that follow from a row's key: the first groups of eight digits of the hex SHA-256
    of ``seed:key``. A null key draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. A text that is cut has none of the marks, and no mark can begin inside one or
    across the border of a part, so the first of each is the one that was set."""
    head, tail = F.split_part(output, F.lit(MIDDLE), F.lit(1)), F.split_part(output, F.lit(MIDDLE), F.lit(2))

    def part(of: Column, mark: str) -> Column:
        return F.split_part(of, F.lit(mark), F.lit(2))

    in_order = F.concat(part(F.split_part(head, F.lit(SUFFIX), F.lit(1)), PREFIX), tail, part(head, SUFFIX))
    turned = F.concat(part(head, PREFIX), tail, part(F.split_part(head, F.lit(PREFIX), F.lit(1)), SUFFIX))
    return F.when(form == "psm", in_order).when(form == "spm", turned).otherwise(output)


def transformed(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    rate: int = 100,
    turned: int = 50,
    seed: int = 7,
    units: str = "lines",
    output: str = "output",
) -> DataFrame:
    """Each row with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars`` (null if plain) and
    ``output``; columns of those names are replaced, all others stay.

    ``rate`` of a hundred texts are cut, ``turned`` of a hundred of these begin with their suffix. A null or empty text, and
    one that holds a mark, is plain; null counts as empty. A row's form follows from its key alone: equal keys draw alike
    whatever their texts, rows that repeat stay as often as they are there, and a null key draws as an empty one. Texts are
    cut whole, however long; an empty table gives an empty result.
    """
    made = ["n", "form", "prefix_chars", "middle_chars", output]
    rest = [c for c in docs.columns if c.lower() not in {m.lower() for m in made}]
    body, found, chosen = unused([*docs.columns, *made], "_body", "_cuts", "_form")
    one, other, whether, which = draws(F.col(key), seed)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(F.col(body), F.lit(mark))
    plain = (F.col(body) == "") | marked | (whether % 100 >= rate)
    rows = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn(chosen, F.when(plain, "plain").when(which % 100 < turned, "spm").otherwise("psm"))
    rows = rows.withColumn(found, cuts(F.col(body), one, other, units))
    data = F.col(body).cast("binary")
    first, second = (F.col(found)[name].cast("int") for name in ("first", "second"))
    pieces = {
        PREFIX: F.substring(data, F.lit(1), first),
        MIDDLE: F.substring(data, first + 1, second - first),
        SUFFIX: F.substring(data, second + 1, F.octet_length(data) - second),
    }

    def ordered(*marks: str) -> Column:
        return F.concat(*(x for mark in marks for x in (F.lit(mark), pieces[mark].cast("string"))))

    psm, spm = ordered(PREFIX, SUFFIX, MIDDLE), ordered(SUFFIX, PREFIX, MIDDLE)
    form, is_cut = F.col(chosen), F.col(chosen) != "plain"
    return rows.select(
        *(F.col(c) for c in rest),
        F.col(found)["n"].alias("n"),
        form.alias("form"),
        F.when(is_cut, F.col(found)["prefix_chars"]).alias("prefix_chars"),
        F.when(is_cut, F.col(found)["middle_chars"]).alias("middle_chars"),
        F.when(form == "psm", psm).when(form == "spm", spm).otherwise(F.col(body)).alias(output),
    )
