import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import relational as R
from quillspark.plans import fixtures as X
from quillspark.session import shared_dir
from quillspark.streaming import corrections as C
from quillspark.streaming import streams as S

ROWS = "document_id long, file_name string, file_path string, processing_status string, current_timestamp_ist timestamp_ntz"


def _rows(spark, *rows):
    return spark.createDataFrame([(i, name, f"/p/{i}", status, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i, name, status in rows], ROWS)


def test_ingest_over_several_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, rows in enumerate([[(2, "a", "Ingested"), (3, "a", "Ingested"), (1, "a", "Deleted"), (4, "b", "Deleted")], [(5, "a", "Ingested"), (6, "b", "Ingested")], [(7, "b", "Ingested"), (8, "c", "Ingested")]]):
            _rows(spark, *rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(_rows(spark, (1, "a", "")).schema).parquet(str(tmp_path / "in"))
            S.ingest_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.document_id: (r.is_duplicate, r.duplicate_of) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    none = (False, None)
    assert got == {1: none, 2: none, 3: (True, "/p/2"), 4: none, 5: (True, "/p/2"), 6: none, 7: (True, "/p/6"), 8: none}


def test_ingest_beyond_the_times_of_pandas(spark, tmp_path):
    """A file of the year 2400 or 1500 is one like others; a microsecond parts two, and equal times are parted by id."""
    far, past = dt.datetime(2400, 1, 1, 0, 0, 0, 1), dt.datetime(1500, 1, 1)
    times = [(1, "a", far + dt.timedelta(microseconds=1)), (2, "a", far), (3, "a", far), (4, "b", far), (5, "b", past), (6, "c", past)]
    rows = spark.createDataFrame([(i, name, f"/p/{i}", "Ingested", at) for i, name, at in times], ROWS)
    with S.rocks(spark):
        got = S.drained(S.ingest_stream(S.as_stream(rows, "far")), "far-out").collect()
    want = R.arrivals(rows).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r.document_id for r in got if r.is_duplicate} == {1, 3, 4}


@pytest.mark.parametrize("groups", [1, 3])
def test_ingest_of_names_that_share_a_group(spark, groups, monkeypatch):
    monkeypatch.setattr(C, "GROUPS", groups)
    r = random.Random(groups)
    rows = [(i, r.choice(["a", "b", "c", "d", "", None]), r.choice(["Ingested", "Deleted"])) for i in range(1, 60)]
    steps, first, want = [rows[:20], rows[40:], rows[20:40]], {}, set()
    for step in steps:
        known = dict(first)
        for i, name, status in step:
            if status != "Deleted":
                first.setdefault(name, i)
        want |= {(i, name, f"/p/{first[name]}" if name in known or name in first and first[name] < i else None) for i, name, _ in step}
    with S.rocks(spark):
        got = S.drained(S.ingest_stream(S.in_steps([_rows(spark, *x) for x in steps], "grouped")), "grouped-out").collect()
    assert {(r.document_id, r.file_name, r.duplicate_of) for r in got} == want and len(got) == len(rows)
    assert all(r.is_duplicate == (r.duplicate_of is not None) for r in got)


def test_a_worker_goes_on_where_it_stopped(spark, sf_dir, tmp_path):
    cls = X.classification(spark, sf_dir)
    name, source = f"t{tmp_path.name}", str(tmp_path / "cls")
    for half in (0, 1):
        cls.filter(F.col("classification_id") % 2 == half).write.mode("append").parquet(source)
        stream = spark.readStream.schema(cls.schema).parquet(source)
        query = S.worker(stream, X.documents(spark, sf_dir), X.ownership(spark, sf_dir), name, "1 second")
        query.processAllAvailable()
        query.stop()
    key = ["user_id", "classification_id", "notification_type"]
    got = spark.read.parquet(f"{shared_dir(spark)}/worker-{name}/out").select(*key).collect()
    want = R.notification_events(cls, X.documents(spark, sf_dir), X.ownership(spark, sf_dir)).select(*key).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
