"""Delivery states and landing checks against plain Python."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.operators import delivery
from millrace.streaming import jobs, state

SENT = "origin string, seq long, sent_ms long, payload string, send_state string"
RECEIVED = "origin string, seq long, recv_ms long, payload string"


def states(spark, sent, received, groups=1, width=None):
    correlated = delivery.correlate_delivery(spark.createDataFrame(sent, SENT), spark.createDataFrame(received, RECEIVED))
    rows = delivery.delivery_order(correlated, groups, width).collect()
    return {r.seq: (r.state, r.transit_ms) for r in rows}


OK = "SEND_SUCCESS"


@pytest.mark.parametrize(
    "sent, received, seq, expected",
    [
        ([(1, OK), (2, OK)], [(2, 50)], 2, "RECEIVED_OUT_OF_ORDER"),
        ([(1, "SEND_FAILURE"), (2, OK)], [(2, 50)], 2, "RECEIVED_CORRECT"),
        ([(2, OK)], [(2, 50)], 2, "RECEIVED_CORRECT"),
        ([(1, OK), (2, OK)], [(1, 40), (2, 50)], 2, "RECEIVED_CORRECT"),
        ([(1, OK), (2, OK)], [(1, 60), (2, 50)], 2, "RECEIVED_OUT_OF_ORDER"),
        ([(1, OK), (2, "SEND_FAILURE"), (3, OK)], [(1, 60), (2, 40), (3, 50)], 3, "RECEIVED_CORRECT"),
        ([(1, OK), (2, "SEND_FAILURE"), (3, OK)], [(1, 60), (2, 70), (3, 50)], 3, "RECEIVED_OUT_OF_ORDER"),
        ([(1, "SENT")], [], 1, "SENT"),
        ([(1, "SEND_REJECTED")], [], 1, "SEND_REJECTED"),
        ([(1, OK)], [(1, 60_001)], 1, OK),
        ([(1, OK)], [(1, 60_000)], 1, "RECEIVED_CORRECT"),
        ([(1, OK)], [(1, 70), (1, 30)], 1, "RECEIVED_CORRECT"),
    ],
)
def test_states(spark, sent, received, seq, expected):
    found = states(spark, [("o", s, 0, "p", st) for s, st in sent], [("o", s, at, "p") for s, at in received])
    assert found[seq][0] == expected


def test_corrupted_and_groups(spark):
    found = states(spark, [("o", s, 0, "p", OK) for s in (-4, -2, -1, 1)], [("o", -2, 5, "x"), ("o", -1, 5, "p"), ("o", 1, 6, "p")], groups=2)
    assert found[-2] == ("RECEIVED_CORRUPTED", 5) and found[-4] == (OK, None)
    assert found[-1][0] == "RECEIVED_CORRECT" and found[1][0] == "RECEIVED_CORRECT"


def brute(sent, received, groups, lifetime=60_000):
    first = {}
    for o, seq, at, payload in received:
        if (o, seq) not in first or at < first[(o, seq)][0]:
            first[(o, seq)] = (at, payload)
    info = {}
    for o, seq, sent_ms, payload, send in sent:
        at, got = first.get((o, seq), (None, None))
        if at is not None and at - sent_ms > lifetime:
            at, got = None, None
        info[(o, seq)] = (send, at, None if at is None else got == payload)
    out = {}
    for (o, seq), (send, at, intact) in info.items():
        if at is None:
            out[seq] = send
            continue
        if not intact:
            out[seq] = "RECEIVED_CORRUPTED"
            continue
        verdict = "RECEIVED_CORRECT"
        for (o2, s2), (send2, at2, _) in sorted(((k, v) for k, v in info.items() if k[0] == o and k[1] < seq and k[1] % groups == seq % groups), reverse=True):
            arrived = at2 is not None and at2 <= at
            if send2 == OK or arrived:
                verdict = "RECEIVED_CORRECT" if arrived else "RECEIVED_OUT_OF_ORDER"
                break
        out[seq] = verdict
    return out


def random_probe(seed, count=600):
    rng = random.Random(seed)
    sent, received = [], []
    for seq in range(count):
        send = rng.choices([OK, "SEND_FAILURE", "SEND_REJECTED"], [6, 2, 1])[0]
        sent.append(("o", seq, 1000 + seq * 1000, f"p{seq}", send))
        if rng.random() < 0.75:
            at = 1000 + seq * 1000 + rng.randrange(100, 70_000)
            received.append(("o", seq, at, f"p{seq}" if rng.random() < 0.9 else "changed"))
            if rng.random() < 0.2:
                received.append(("o", seq, at + 7, f"p{seq}"))
    return sent, received


@pytest.mark.parametrize("seed, width", [(1, 30), (2, None)])
def test_order_matches_brute_force(spark, seed, width):
    sent, received = random_probe(seed)
    assert {s: st for s, (st, _) in states(spark, sent, received, 5, width).items()} == brute(sent, received, 5)


def test_stream_reports_the_same_states(spark, path):
    """Events arrive in several files; each message is reported once, when its lifetime is over."""
    sent, received = random_probe(9, 300)
    events = []
    for o, seq, at, payload, send in sent:
        crc = zlib.crc32(payload.encode())
        events += [(o, seq, "sent", 0, None, crc, at), (o, seq, "response", 1, send, crc, at)]
    events += [(o, seq, "received", 2, None, zlib.crc32(p.encode()), at) for o, seq, at, p in received]
    events.sort(key=lambda e: (e[6], e[3]))
    events.append(("o", 10**6, "sent", 0, None, 0, 10**7))  # time passes
    schema = "origin string, seq long, kind string, step int, state string, checksum long, at_ms long"
    for i in range(6):
        part = events[i * len(events) // 6 : (i + 1) * len(events) // 6]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path("events"))
    followed = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path("events"))
        .withColumn("group", delivery.probe_group(F.col("seq"), 5)).withColumn("at", F.timestamp_millis("at_ms"))
    )
    rows = jobs.drain(state.delivery_state_stream(followed), path("out"), path("cp")).collect()
    assert len(rows) == len({r.seq for r in rows}) == 300
    assert {r.seq: r.state for r in rows} == brute(sent, received, 5)


def test_gaps_and_boundaries(spark):
    crc = zlib.crc32(b"p")
    rows = [("d1", s, s % 3, "p", crc) for s in range(12) if s not in (4, 5)] + [("d1", 3, 0, "p", crc)] * 50
    rows += [("d2", s, s % 3, "p", crc) for s in range(12, 20)] + [("d2", 20, 1, "p", 1)]
    landed = spark.createDataFrame(rows, "acquisition_instant string, seq long, `group` int, payload string, checksum long")
    found = {r.acquisition_instant: r for r in delivery.landing_gap_check(landed, groups=3, slice_seqs=6).collect()}
    assert (found["d1"].records, found["d1"].duplicates, found["d1"].gaps, found["d1"].wrong_group) == (60, 50, 2, 0)
    assert (found["d2"].wrong_group, found["d2"].changed_payload, found["d2"].duplicates) == (1, 1, 0)
    ends = {(r.acquisition_instant, r.group): r.boundary_ok for r in delivery.landing_boundary_check(landed.where("seq <> 20"), groups=3).collect()}
    assert all(ends.values())
    cut = {(r.acquisition_instant, r.group): r.boundary_ok for r in delivery.landing_boundary_check(landed.where("seq not in (20, 9)"), groups=3).collect()}
    assert cut[("d2", 0)] is False and cut[("d1", 0)] is True


def test_commits(spark):
    commits = spark.createDataFrame([("a",), ("b",), ("c",)], "correlation_id string")
    answers = spark.createDataFrame([("a", True), ("b", False), ("z", True)], "correlation_id string, success boolean")
    rows = delivery.correlate_commits(commits, answers).collect()
    assert {r.correlation_id: r.result for r in rows} == {"a": "committed", "b": "failed", "c": "closed", "z": "unknown"}


def test_report_of_nothing_received(spark):
    rows = spark.createDataFrame([("SEND_FAILURE", None)] * 3, "state string, transit_ms long")
    report = delivery.sli_report(rows).first()
    assert (report.total, report.correct, report.transit_p99_ms, report.correct_share) == (3, 0, None, 0.0)
