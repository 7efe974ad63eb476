import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import relational as R
from quillspark.plans import fixtures as X
from quillspark.session import place
from quillspark.streaming import dashboards as D
from quillspark.streaming import streams as S
from tests.compare import spark_rows


@pytest.fixture(scope="module")
def states(spark, sf_dir):
    """The document table as it changes, and the changes from each state to the next, of rows of a state of their own."""
    rows, states = X.arrivals(spark, sf_dir).filter("document_id < 120").cache(), []
    for k in range(4):
        pick = (F.col("document_id") * 7 + k) % 5
        states.append(rows)
        rows = rows.filter(pick != 4).withColumns({"processing_status": F.when(pick == 0, "Deleted").when(pick == 1, F.lit(None)).when(pick == 2, "Duplicate").otherwise(F.col("processing_status")), "source_type": F.when(pick == 3, F.lit(None)).otherwise(F.col("source_type"))})
    return [*states, rows]


@pytest.fixture(scope="module")
def steps(states):
    return [D.changes(None, states[0]), *[D.changes(a, b) for a, b in zip(states, states[1:], strict=False)]]


def same(table, rows):
    for name in ("files_summary", "sources", "stats_totals", "stats_by_source"):
        assert spark_rows(getattr(D, name)(table)) == spark_rows(getattr(R, name)(rows)), name
    for as_of, zone, days in ((X.AS_OF, "Asia/Kolkata", 30), ("2024-01-20 07:15:00", "America/New_York", 17)):
        assert spark_rows(D.stats_by_day(table, as_of, zone, days)) == spark_rows(R.stats_by_day(rows, as_of, zone, days))


@pytest.mark.parametrize("seed", [None, 1])
def test_batches_in_any_order(steps, states, seed):
    order = list(steps)
    if seed is not None:
        random.Random(seed).shuffle(order)
    same(S.counted(order), states[-1])


def test_every_batch_shows(spark, steps, states):
    table = D.CellTable(spark, place(spark, "cells"))
    for k, step in enumerate(steps):
        assert table.write(k, *D.cell_changes(step))
        assert not table.write(k, *D.cell_changes(step))  # a replay
        same(table, states[k])
    small = table.compacted(place(spark, "cells"))
    same(small, states[-1])
    assert small.write(9, *D.cell_changes(D.changes(states[-1], None)))
    assert small.read().count() == 0


def test_a_batch_that_died_is_written_over(spark, steps, states, monkeypatch):
    table = D.CellTable(spark, place(spark, "cells"))
    table.write(0, *D.cell_changes(steps[0]))
    with monkeypatch.context() as m:
        m.setattr(table, "_commit", lambda batch: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.write(1, *D.cell_changes(steps[1]))
    same(table, states[0])
    assert table.write(1, *D.cell_changes(steps[1]))
    same(table, states[1])


def test_reads_deltas_only(steps):
    files = D.files_summary(S.counted(steps)).inputFiles()
    assert files and all("/deltas/_batch=" in f for f in files)


def test_nothing_and_odd_times(spark):
    table = D.CellTable(spark, place(spark, "cells"))
    assert D.files_summary(table).first().total == 0 and D.stats_by_day(table, X.AS_OF).count() == 0
    with pytest.raises(ValueError):
        D.stats_by_day(table, "2024-02-12 00:00:01")
    none = spark.createDataFrame([(None, None)], f"before struct<{D._CELLS.rpartition(',')[0]}>, after struct<{D._CELLS.rpartition(',')[0]}>")
    lost = spark.createDataFrame([(1, None, "Outlook", None)], "document_id long, processing_status string, source_type string, current_timestamp_ist timestamp_ntz")
    table.write(0, *D.cell_changes(none.unionByName(D.changes(None, lost))))
    same(table, lost)
