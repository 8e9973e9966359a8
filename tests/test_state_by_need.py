"""Delivery states are read by need: the processor against a stand-in for its state, which counts what is read."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row

from millrace.streaming.state import Delivery

LIFETIME = 60_000


class Held:
    """State of one key, as the processor's handle gives it."""

    def __init__(self):
        self.value, self.entries, self.timers, self.reads, self.rows_read = None, {}, set(), 0, 0

    def getValueState(self, name, schema):
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=self._update, clear=lambda: self._update(None))

    def _update(self, value):
        self.value = value

    def getMapState(self, name, key, schema):
        return SimpleNamespace(getValue=self._get, updateValue=self.entries.__setitem__, removeKey=self.entries.pop)

    def _get(self, key):
        self.reads += 1
        self.rows_read += len(self.entries[key][0])
        return self.entries[key]

    def registerTimer(self, at):
        self.timers.add(at)


def started(size=None):
    held, work = Held(), Delivery(LIFETIME)
    if size:
        work.RANGE = size
    work.init(held)
    return held, work


def feed(work, rows):
    assert list(work.handleInputRows(("o", 1), iter(rows), None)) == []


def expire(held, work, now):
    out = []
    while due := sorted(t for t in held.timers if t <= now):
        held.timers.discard(due[0])
        out += [tuple(r) for r in work.handleExpiredTimer(("o", 1), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), None)]
    return out


def event(kind, seq, at, state=None, checksum=7):
    return Row(kind=kind, step={"sent": 0, "response": 1, "received": 2}[kind], seq=seq, at_ms=at, state=state, checksum=checksum)


@pytest.mark.parametrize("seed", range(6))
def test_ranges_of_any_size_report_alike(seed):
    """Small ranges against one that holds every message, over random batches, losses, repeats and timers."""
    draw = random.Random(seed)
    events = []
    for seq in range(400):
        at = seq * 1000
        events.append(event("sent", seq, at))
        events.append(event("response", seq, at, draw.choice(["SEND_SUCCESS", "SEND_SUCCESS", "SEND_FAILURE", "SEND_REJECTED"])))
        for _ in range(draw.choice([0, 1, 1, 1, 2])):
            events.append(event("received", seq, at + draw.randrange(LIFETIME + 5000), checksum=draw.choice([7, 7, 7, 8])))
    events.append(event("received", 9999, 5))  # never sent
    events.sort(key=lambda e: e.at_ms)
    small, whole = started(4), started(10**9)
    reported = {}
    for begin in range(0, len(events), 57):
        batch = events[begin : begin + 57]
        draw.shuffle(batch)
        for held, work in (small, whole):
            feed(work, batch)
            reported.setdefault(work.RANGE, []).extend(sorted(expire(held, work, max(e.at_ms for e in batch))))
    for held, work in (small, whole):
        reported[work.RANGE].extend(sorted(expire(held, work, 10**9)))
    assert reported[4] == reported[10**9]
    assert sorted(r[2] for r in reported[4]) == list(range(400))
    # What is left is the one message that later ones are judged against.
    assert sum(len(m[0]) for m in small[0].entries.values()) == sum(len(m[0]) for m in whole[0].entries.values()) == 1


def test_a_hot_key_reads_what_a_batch_touches():
    held, work = started()
    many = 50_000
    feed(work, [e for seq in range(many) for e in (event("sent", seq, seq), event("response", seq, seq, "SEND_SUCCESS"))])
    held.reads = held.rows_read = 0
    feed(work, [event("received", seq, many) for seq in range(1000, 1010)])
    assert held.reads <= 2 and held.rows_read <= 2 * Delivery.RANGE
    held.reads = held.rows_read = 0
    assert len(expire(held, work, LIFETIME + 99)) == 100
    assert held.reads == 1 and held.rows_read == Delivery.RANGE


def test_no_rows_and_nothing_due_read_nothing():
    held, work = started()
    feed(work, [])
    assert held.value is None and expire(held, work, 10**9) == []
    feed(work, [event("received", 3, 5), event("response", 3, 5, "SEND_SUCCESS")])
    assert held.entries == {} and held.reads == 0


def test_a_hot_key_costs_one_timer_and_bounded_memory():
    """Whatever a batch brings for a key: one timer goes off, few ranges are held as messages, and nothing else changes."""
    draw = random.Random(3)
    events = []
    for seq in range(3000):
        at = seq * 1000
        events += [event("sent", seq, at), event("response", seq, at, draw.choice(["SEND_SUCCESS", "SEND_FAILURE"]))]
        if draw.random() < 0.7:
            events.append(event("received", seq, at + draw.randrange(LIFETIME + 5000)))
    few, all_held = started(4), started(4)
    few[1].MOST, most = 5, 0
    of = few[1]._of

    def watched(number):
        nonlocal most
        found = of(number)
        most = max(most, len(few[1].held))
        return found

    few[1]._of = watched
    out = []
    for held, work in (few, all_held):
        feed(work, events)
        assert len(held.timers) == 1
        out.append(sorted(expire(held, work, 10**9)))
        assert sum(len(m[0]) for m in held.entries.values()) == 1
    assert out[0] == out[1] and len(out[0]) == 3000 and most <= 5
