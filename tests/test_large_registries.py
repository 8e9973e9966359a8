"""Jobs over registries of many streams: nothing of them goes through the driver or one task."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from millrace.operators import registry
from millrace.queries import inputs

SF = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", "key_path_check patch_rules validate_patches create_stream destination_changes delete_stream deletable_version pii_evolution".split())
def test_streams_are_not_collected_on_the_driver(spark, name):
    """Their rows are made of others, so the planner's guess of their size is far too low."""
    assert "Broadcast" not in plan(entry_points.queries()[name](spark, SF))


@pytest.mark.parametrize("name", "latest_active_schema deletable_version schema_pairs join_writer_schema pii_evolution".split())
def test_schemas_are_dealt_out_before_they_are_made(spark, name):
    """A file of customers makes texts many times its size, which one task would otherwise hold."""
    text = plan(entry_points.queries()[name](spark, SF))
    below = [part.split("Scan parquet")[0] for part in text.split("Generate explode(sequence(1")[1:]]
    assert below and all("REPARTITION_BY_NUM" in part for part in below)


def test_versions_to_delete_meet_schemas_that_are_dealt_out(spark):
    text = plan(entry_points.queries()["flag_deleted_schema"](spark, SF))
    below = [part.split("Scan parquet")[0] for part in text.split("Generate explode(sequence(1")[1:]]
    assert below and all("REPARTITION_BY_NUM" in part for part in below)


def test_no_task_makes_most_of_the_schemas(spark):
    """What the newest version is picked from comes from many tasks, however few files list the customers."""
    parts = inputs.schemas(spark, SF).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) * 2 < sum(r["count"] for r in parts)


def test_python_holds_few_schemas_at_a_time(spark):
    """Batches of nodes stay small, however many schemas a batch of the scan brings; repeated and unreadable ones included."""
    wide = [f'{{"type":"record","name":"r","fields":[{{"name":"a{k % 3}","type":["null","int"]}},{{"name":"b","type":"string"}}]}}' for k in range(4500)]
    wide[7], wide[2600] = None, "no schema"
    rows = spark.createDataFrame([(f"s{k}", 1, text) for k, text in enumerate(wide)], "stream string, version int, schema_json string").coalesce(1)
    found = {(r.stream, r.path): (r.type, r.nullable, r.branch_types) for r in registry.schema_fields(rows).collect()}
    expected = {}
    for k, text in enumerate(wide):
        for row in registry._nodes(text):
            expected[f"s{k}", row[0]] = (row[6], row[7], row[12])
    assert found == expected
    batch = pa.RecordBatch.from_pydict({"schema_json": wide})
    assert [b.num_rows for b in registry._slices(iter([batch]))] == [1000, 1000, 1000, 1000, 500]
