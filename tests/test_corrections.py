import datetime as dt
import random

import pytest

from quillspark.operators import relational as R
from quillspark.streaming import corrections as C
from quillspark.streaming import streams as S

ROWS = "document_id long, file_name string, file_path string, processing_status string, ts timestamp_ntz, seq long"


def event(doc, name, hour, status="Ingested", seq=0):
    return (doc, name, f"/p/{doc}", status, dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour), seq)


def final(spark, steps):
    rows = S.ingest_corrected([spark.createDataFrame(x, ROWS) for x in steps]).collect()
    return {r.document_id: (r.processing_status, r.is_duplicate, r.duplicate_of) for r in rows}


def rescanned(spark, steps):
    last = {}
    for e in (e for step in steps for e in step):
        if e[0] not in last or e[5] > last[e[0]][5]:
            last[e[0]] = e
    rows = [(d, n, p, s, t, False, None) for d, n, p, s, t, _ in last.values()]
    table = spark.createDataFrame(rows, "document_id long, file_name string, file_path string, processing_status string, current_timestamp_ist timestamp_ntz, is_duplicate boolean, duplicate_of string")
    return {r.document_id: (r.processing_status, r.is_duplicate, r.duplicate_of) for r in R.rescan(table).collect()}


def test_late_copies_and_deletions(spark):
    steps = [
        [event(5, "a", 5), event(6, "a", 6), event(7, "b", 7)],
        [event(1, "a", 1)],  # older than the head
        [event(1, "a", 1, "Deleted", 1)],  # which goes again
        [event(5, "a", 5, "Deleted", 1), event(8, "b", 7), event(9, "c", 9, "Deleted")],
    ]
    o = ("Original", False, None)
    assert final(spark, steps[:1]) == {5: o, 6: ("Duplicate", True, "/p/5"), 7: o}
    assert final(spark, steps[:2]) == {1: o, 5: ("Duplicate", True, "/p/1"), 6: ("Duplicate", True, "/p/1"), 7: o}
    gone = ("Deleted", False, None)
    assert final(spark, steps) == {1: gone, 5: gone, 6: o, 7: o, 8: ("Duplicate", True, "/p/7"), 9: gone} == rescanned(spark, steps)


def test_beyond_the_times_of_pandas(spark):
    """Files of the years 2400 and 1500 are ones like others, and a microsecond parts two."""
    far, past = dt.datetime(2400, 1, 1, 0, 0, 0, 1), dt.datetime(1500, 1, 1)
    at = lambda doc, name, ts, *more: (*event(doc, name, 0, *more)[:4], ts, *event(doc, name, 0, *more)[5:])
    steps = [[at(1, "a", far + dt.timedelta(microseconds=1)), at(2, "a", far), at(3, "b", far)], [at(4, "b", past), at(2, "a", far, "Deleted", 1)], [at(5, "a", far)]]
    got = final(spark, steps)
    assert got == rescanned(spark, steps) and got[1] == ("Duplicate", True, "/p/5") and got[3] == ("Duplicate", True, "/p/4")


@pytest.mark.parametrize("seed", range(3))
def test_any_order_ends_in_the_rescan(spark, seed, monkeypatch):
    monkeypatch.setattr(C, "FRAME", 3)
    r = random.Random(seed)
    events = [event(d, r.choice("abc"), r.randrange(6)) for d in range(40)]
    events += [(*e[:3], "Deleted", e[4], 1) for e in r.sample(events, 15)]
    events += [(*e[:3], "Ingested", e[4], 2) for e in r.sample(events[40:], 5)]
    r.shuffle(events)
    edges = sorted(r.sample(range(1, len(events)), 3))
    steps = [events[a:b] for a, b in zip([0, *edges], [*edges, len(events)], strict=True)]
    assert final(spark, steps) == rescanned(spark, steps)


def test_names_that_share_a_group(spark, monkeypatch):
    """States of names that lie together don't mix."""
    monkeypatch.setattr(C, "GROUPS", 1)
    monkeypatch.setattr(C, "FRAME", 4)
    r = random.Random(7)
    events = [event(d, r.choice(["a", "b", "c", "d", ""]), r.randrange(6)) for d in range(40)]
    events += [(*e[:3], "Deleted", e[4], 1) for e in r.sample(events, 20)]
    events += [(*e[:3], "Ingested", e[4] - dt.timedelta(hours=r.randrange(3)), 2) for e in r.sample(events[40:], 8)]
    r.shuffle(events)
    steps = [events[:15], events[15:30], events[30:31], events[31:]]
    assert final(spark, steps) == rescanned(spark, steps)


def test_only_what_changes_is_sent(spark, tmp_path):
    """A younger copy costs one row, a new head all of its name."""
    out = []
    steps = [[event(d, "a", d) for d in range(10, 20)], [event(30, "a", 30)], [event(1, "a", 1)], [event(1, "a", 1)]]
    stream = C.corrected(S.in_steps([spark.createDataFrame(x, ROWS) for x in steps], "sent"))
    with C.rocks(spark):
        stream.writeStream.foreachBatch(lambda rows, n: out.append(rows.count())).option("checkpointLocation", f"file://{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()
    assert out == [10, 1, 12, 0]
