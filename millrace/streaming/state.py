"""Stateful streams: documents folded from patches, change events, delivery states.

Spark gives no order within a micro-batch, so every processor sorts the rows of its key by their sequence
number before it acts on them. Rows and state go as rows, not frames: most keys bring few rows to a batch.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

from millrace.functions.jsonpatch import MISSING, PatchError, apply_set
from millrace.operators.delivery import LIFETIME_MS, SEND_STATES
from millrace.operators.model import UNREADABLE, compact_json, valid_set

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """Keep stream state on disk beside the executors, backed by the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _sorted(rows: Iterator[Row], *by: str) -> list[Row]:
    """The rows one micro-batch brings for one key, in order. ``maxFilesPerTrigger`` bounds them."""
    return sorted(rows, key=attrgetter(*by))


def _ordered(rows: Iterator[Row]) -> Iterator[tuple]:
    """The probe events one micro-batch brings for one key, by time, step and number: (kind, seq, at_ms, state, checksum).
    They are kept as numbers, some 30 bytes each."""
    codes: dict[tuple, int] = {}
    at, seqs, crcs, code = array("q"), array("q"), array("q"), array("i")
    for row in rows:
        at.append(row.at_ms)
        seqs.append(row.seq)
        crcs.append(0 if row.checksum is None else row.checksum)
        code.append(codes.setdefault((row.step, row.kind, row.state, row.checksum is None), len(codes)))
    if not at:
        return
    kinds, which = list(codes), np.frombuffer(code, np.int32)
    step = np.array([kind[0] for kind in kinds])[which]
    order = np.lexsort((np.frombuffer(seqs, np.int64), step, np.frombuffer(at, np.int64)))
    del step
    for start in range(0, len(order), 10_000):
        for k in order[start : start + 10_000].tolist():
            _, kind, state, unknown = kinds[code[k]]
            yield kind, seqs[k], at[k], state, None if unknown else crcs[k]


class PatchFold(StatefulProcessor):
    """Holds one document; answers each patch set with the new document, NULL once it is removed."""

    def init(self, handle) -> None:
        self.document = handle.getValueState("document", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        document = json.loads(self.document.get()[0]) if self.document.exists() else MISSING
        for row in _sorted(rows, "seq"):
            reason = None if row.valid else UNREADABLE
            try:
                if row.valid:
                    document = apply_set(document, [(o["op"], o["path"], o["value"]) for o in row.operations])
            except (PatchError, ValueError) as error:
                reason = str(error)
            yield Row(document_id=key[0], seq=row.seq, document=None if document is MISSING else compact_json(document), reason=reason)
        if document is MISSING:
            self.document.clear()
        else:
            self.document.update((compact_json(document),))

    def close(self) -> None:
        pass


def model_state_stream(patches: DataFrame) -> DataFrame:
    """Follow a patch log: ``(document_id, seq, document, reason)`` per set. Sets that can't be tried are told by
    the same rule as in the batch fold, and change nothing."""
    use_rocksdb(patches.sparkSession)
    id_type = patches.schema["document_id"].dataType.simpleString()
    seq_type = patches.schema["seq"].dataType.simpleString()
    judged = patches.select("document_id", "seq", valid_set().alias("valid"), "operations")
    return judged.groupBy("document_id").transformWithState(
        PatchFold(), f"document_id {id_type}, seq {seq_type}, document string, reason string", "append", "none"
    )


class Changes(StatefulProcessor):
    """Remembers the last value of a key and tells what each write changed."""

    def init(self, handle) -> None:
        self.value = handle.getValueState("value", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.value.get()[0] if self.value.exists() else None
        for row in _sorted(rows, "offset"):
            new = row.value
            change = "remove" if new is None else "new" if old is None else "update"
            yield Row(key=key[0], offset=row.offset, change=change, old=old, new=new, same=old is not None and old == new)
            old = new
        if old is None:
            self.value.clear()
        else:
            self.value.update((old,))

    def close(self) -> None:
        pass


def change_stream(log: DataFrame) -> DataFrame:
    """Follow a keyed log ``(key, offset, value)``: ``(key, offset, change, old, new, same)``."""
    use_rocksdb(log.sparkSession)
    key_type = log.schema["key"].dataType.simpleString()
    return log.where("key is not null").groupBy("key").transformWithState(
        Changes(), f"key {key_type}, offset bigint, change string, old string, new string, same boolean", "append", "none"
    )


class Delivery(StatefulProcessor):
    """Tracks the probe messages of one (origin, group) and reports each when its lifetime ends.

    State is kept for two lifetimes, so that every receipt still finds the messages before it; of the older
    ones only the newest that got on its way stays, because later messages are judged against it.

    Messages are held by ranges of ``RANGE`` sequence numbers and read by need: a batch
    or a timer reads the ranges it touches and, for a verdict, the nearest range before that has a message on its way.
    Beside them the state has one list of ranges, an entry each, so a key with many messages under way costs the rows
    that come, not the rows that wait. A key has one timer, for what is due first; when it goes off, all that is due is reported.

    What a micro-batch brings for a key waits in arrays of numbers, and no more than ``MOST`` ranges are held as messages.
    """

    RANGE = 256
    MOST = 1024
    MESSAGES = "messages array<struct<seq: bigint, sent_ms: bigint, state: string, recv_ms: bigint, checksum: bigint, reported: boolean>>"
    #: When something is due in a range (null: never), whether a message there got on its way, and whether it only stays for later ones.
    RANGES = "ranges array<struct<range: bigint, due_ms: bigint, on_way: boolean, rest: boolean>>"

    def __init__(self, lifetime_ms: int):
        self.lifetime_ms = lifetime_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.ranges = handle.getValueState("ranges", self.RANGES)
        self.messages = handle.getMapState("messages", "range bigint", self.MESSAGES)

    def _open(self) -> None:
        """What one call works on: the list of ranges, the messages read so far, and the ranges that changed."""
        known = self.ranges.get()[0] if self.ranges.exists() else []
        self.index = {e[0]: tuple(e[1:]) for e in known}
        self.ways = sorted(n for n, entry in self.index.items() if entry[1])
        self.held: dict[int, dict[int, tuple]] = {}
        self.changed: set[int] = set()
        self.staying: set[int] = set()

    def _of(self, number: int) -> dict[int, tuple]:
        """The messages of a range by sequence number, read from the state once per call, or again if let go of since."""
        if number not in self.held:
            if len(self.held) >= self.MOST:
                self._write()
            rows = self.messages.getValue((number,))[0] if number in self.index else []
            self.held[number] = {m[0]: tuple(m[1:]) for m in rows}
        return self.held[number]

    def _put(self, seq: int, message: tuple) -> None:
        number = seq // self.RANGE
        held = self._of(number)
        held[seq] = message
        due, on_way, _ = self.index.get(number, (None, False, False))
        if not on_way and self._on_way(message):
            insort(self.ways, number)
            on_way = True
        self.index[number] = (due, on_way, False)
        self.changed.add(number)

    def _write(self) -> None:
        """Write the ranges that changed, with what is due next in each, and let go of all that are held."""
        for number in sorted(self.changed):
            held = self.held[number]
            if not held:
                del self.index[number]
                self.messages.removeKey((number,))
                continue
            waits = [m[0] + self.lifetime_ms * (2 if m[4] else 1) for seq, m in held.items() if seq not in self.staying]
            due = min(waits, default=None)
            self.index[number] = (due, any(map(self._on_way, held.values())), due is None)
            self.messages.updateValue((number,), ([(seq, *held[seq]) for seq in sorted(held)],))
        self.held.clear()
        self.changed.clear()

    def _close(self) -> None:
        """Write what changed, the list of ranges, and a timer for what is due first."""
        self._write()
        due = min((entry[0] for entry in self.index.values() if entry[0] is not None), default=None)
        if due is not None:
            self.handle.registerTimer(due)
        if self.index:
            self.ranges.update(([(number, *entry) for number, entry in sorted(self.index.items())],))
        elif self.ranges.exists():
            self.ranges.clear()

    def _on_way(self, message) -> bool:
        return message[1].startswith("RECEIVED") or SEND_STATES.get(message[1], False)

    def _verdict(self, seq: int, intact: bool) -> str:
        if not intact:
            return "RECEIVED_CORRUPTED"
        number = seq // self.RANGE
        while number is not None:
            held = self._of(number)
            before = max((k for k, m in held.items() if k < seq and self._on_way(m)), default=None)
            if before is not None:
                return "RECEIVED_CORRECT" if held[before][2] is not None else "RECEIVED_OUT_OF_ORDER"
            place = bisect_left(self.ways, number)
            number = self.ways[place - 1] if place else None
        return "RECEIVED_CORRECT"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._open()
        for kind, seq, at_ms, answer, crc in _ordered(rows):
            if kind == "sent":
                self._put(seq, (at_ms, "SENT", None, crc, False))
                continue
            message = self._of(seq // self.RANGE).get(seq)
            if message is None:
                continue
            sent_ms, state, recv_ms, checksum, reported = message
            if kind == "response" and state == "SENT":
                state = answer
            elif kind == "received" and recv_ms is None and at_ms - sent_ms <= self.lifetime_ms:
                state, recv_ms = self._verdict(seq, checksum == crc), at_ms
            self._put(seq, (sent_ms, state, recv_ms, checksum, reported))
        self._close()
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        self._open()
        # One range at most keeps a message only for later ones; below the highest, such messages have nothing to say.
        top = max((number for number, entry in self.index.items() if entry[2]), default=None)
        for number in sorted(n for n, entry in self.index.items() if entry[0] is not None and entry[0] <= now):
            held = self._of(number)
            for seq, (sent_ms, state, recv_ms, checksum, reported) in sorted(held.items()):
                if not reported and sent_ms + self.lifetime_ms <= now:
                    yield Row(origin=key[0], group=key[1], seq=seq, state=state, transit_ms=None if recv_ms is None else recv_ms - sent_ms)
                    held[seq] = (sent_ms, state, recv_ms, checksum, True)
            self.changed.add(number)
            done = [seq for seq, m in held.items() if m[0] + 2 * self.lifetime_ms <= now]
            newest = max((seq for seq in done if self._on_way(held[seq])), default=None)
            for seq in done:
                if seq != newest:
                    del held[seq]
            if newest is None:
                continue
            if top is not None and top > number:
                del held[newest]
                continue
            self.staying.add(newest)
            if top is not None and top < number:
                below = self._of(top)
                for seq in [k for k, m in below.items() if m[0] + 2 * self.lifetime_ms <= now]:
                    del below[seq]
                    self.staying.discard(seq)
                self.changed.add(top)
            top = number
        self._close()

    def close(self) -> None:
        pass


def delivery_state_stream(events: DataFrame, lifetime_ms: int = LIFETIME_MS) -> DataFrame:
    """Follow probe events and report each message's end state once its lifetime has passed.

    ``events(origin, group, seq, kind, step, state, checksum, at_ms, at)`` with kind sent / response /
    received, ``step`` their order at equal times, ``state`` the outcome of a response and ``checksum`` the CRC
    of the payload; ``at`` is the event time.
    """
    use_rocksdb(events.sparkSession)
    return (
        events.withWatermark("at", "0 seconds")
        .groupBy("origin", "group")
        .transformWithState(
            Delivery(lifetime_ms), "origin string, group int, seq bigint, state string, transit_ms bigint", "append", "eventTime"
        )
    )
