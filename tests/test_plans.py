"""What the plans must not hold, and what must reach the scan."""

import re

import pytest

import __spark_entry__ as entry_points
from millrace.queries import all_queries
from millrace.queries.inputs import event_log
from millrace.sources.log import bounded_offset_scan

SF = "/root/testdata/sf0.001"
BATCH = (
    "log_scan bounded_scan joined_bounded_scan start_position plan_landing landed_counts conform_accepted serve_masked mask_nested "
    "available_filter cidr_access write_access grant_check delivery_order gap_check change_capture latest_by_key compact_log "
    "replica_inventory key_path_check read_faults status_drift"
).split()


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """As if every side were too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", BATCH)
def test_no_products_and_no_lone_windows(no_broadcast, name):
    text = plan(entry_points.queries()[name](no_broadcast, SF))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    for window in re.findall(r"Window \[.*", text):
        assert not re.search(r"\], \[\], \[", window), window  # an unpartitioned window is one task


@pytest.mark.parametrize("name", ["conform_accepted", "serve_masked", "mask_nested", "split_envelope", "admin_access", "partition_by_key", "responses"])
def test_narrow_work_does_not_shuffle(spark, name):
    text = plan(entry_points.queries()[name](spark, SF))
    assert "Exchange" not in text and "Python" not in text


def test_only_needed_columns_are_read(spark):
    text = plan(bounded_offset_scan(event_log(spark, SF), "2:5,9").select("event_id"))
    assert "ReadSchema: struct<event_id:bigint,offset:bigint>" in text
    assert "GreaterThanOrEqual(offset,5)" in text


@pytest.mark.parametrize("name", ["resume_read", "joined_bounded_scan"])
def test_reads_by_position_join_nothing(no_broadcast, name):
    """The log is filtered where it is scanned, however the ranges are held."""
    text = plan(entry_points.queries()[name](no_broadcast, SF))
    assert "Exchange" not in text and "Join" not in text
    assert "GreaterThanOrEqual(offset," in text and "PartitionFilters: [" in text


def test_stored_ends_are_read_instead_of_the_log(spark):
    for name in ("latest_offsets", "plan_landing"):
        text = plan(entry_points.queries()[name](spark, SF))
        assert set(re.findall(r"ReadSchema: (\S+)", text)) <= {"struct<partition:int,end:bigint>", "struct<partition:int>"}


def test_every_query_has_an_oracle():
    assert {name for name, (_, sql) in all_queries().items() if not sql} == set()


def test_compatibility_takes_few_scans_and_exchanges(no_broadcast):
    """The report itself, beyond the canonical forms: every pair is judged where its schemas meet."""
    text = plan(entry_points.queries()["compat_report"](no_broadcast, SF))
    assert len(re.findall(r"FileScan", text)) <= 4 and len(re.findall(r"Exchange hashpartitioning", text)) <= 3
    text = plan(entry_points.queries()["register_schema"](no_broadcast, SF))
    assert len(re.findall(r"FileScan", text)) <= 11 and len(re.findall(r"Exchange hashpartitioning", text)) <= 11
