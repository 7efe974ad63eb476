import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from quillspark.operators import relational as R
from quillspark.plans import fixtures as X
from quillspark.plans.queries import _embedding_steps
from quillspark.streaming import sinks as K
from quillspark.streaming import streams as S

ROWS = "k long, a string, b string"


def table(spark, tmp_path, name="t", cls=K.KeyedTable):
    return cls(spark, f"file://{tmp_path}/{name}", _parse_datatype_string(ROWS), ["k"])


def rows(spark, *data):
    return spark.createDataFrame(list(data), ROWS)


def now(t):
    return sorted((tuple(r) for r in t.read().collect()), key=repr)


def test_kinds_of_changes(spark, tmp_path):
    t = table(spark, tmp_path)
    assert now(t) == []
    assert t.write(0, K.Change(rows(spark, (1, "a", "b"), (2, "c", None), (None, "n", "n"))))
    assert t.write(1, K.Change(rows(spark, (1, "x", "mark"), (3, "new", "whole")), K.MARK, ("b",)), K.Change(rows(spark, (2, "late", "late"), (4, "in", "in")), K.INSERT))
    assert now(t) == sorted([(1, "a", "mark"), (2, "c", None), (3, "new", "whole"), (4, "in", "in"), (None, "n", "n")], key=repr)
    assert t.write(2, K.Change(rows(spark, (1, None, "up"), (4, "up", None), (None, "m", None))), K.Change(rows(spark, (4, "z", "z")), K.MARK, ("a",)))
    assert now(t) == sorted([(1, None, "up"), (2, "c", None), (3, "new", "whole"), (4, "z", None), (None, "m", None)], key=repr)
    assert not t.write(2, K.Change(rows(spark, (9, "x", "x")))) and not t.write(0, K.Change(rows(spark, (9, "x", "x"))))
    small = t.compacted(f"file://{tmp_path}/small")
    assert now(small) == now(t) and small.committed() == [2] and not small.write(1, K.Change(rows(spark, (9, "x", "x"))))
    assert small.write(3, K.Change(rows(spark, (2, "q", "q")), K.INSERT)) and now(small) == now(t)


def test_order_within_a_batch(spark, tmp_path):
    t = table(spark, tmp_path)
    seq = rows(spark, (1, "c", "3"), (1, "a", "1"), (1, "b", "2"))
    t.write(0, K.Change(seq, order=(F.col("b"),)))
    assert now(t) == [(1, "c", "3")]
    u = table(spark, tmp_path, "u")
    u.write(0, K.Change(seq, K.INSERT, order=(F.col("b"),)))
    assert now(u) == [(1, "a", "1")]


class Dies(K.KeyedTable):
    """Dies before or after one batch's line in the ledger, once."""

    when = None

    def _commit(self, batch):
        at, self.when = self.when, None if self.when and self.when[1] == batch else self.when
        if at == ("before", batch):
            raise RuntimeError("killed")
        super()._commit(batch)
        if at == ("after", batch):
            raise RuntimeError("killed")


@pytest.mark.parametrize("when", [("before", 1), ("after", 1), ("before", 2), ("before", 0)])
def test_a_killed_batch_is_replayed(spark, sf_dir, tmp_path, when):
    """The table is the batch upsert's, wherever the stream dies between a batch's rows and its line."""
    steps = _embedding_steps(spark, sf_dir)
    key = ["document_id", "chunk_index"]
    t = Dies(spark, f"file://{tmp_path}/t", steps[0].schema, key)
    t.when = when
    stream = S.in_steps([x.withColumn("seq", F.lit(k)) for k, x in enumerate(steps)], "killed")
    state = f"file://{tmp_path}/state"
    with pytest.raises(Exception, match="killed"):
        t.sink(stream, state, K.embedding_changes).awaitTermination()
    assert t.committed() == list(range(when[1] + (when[0] == "after")))
    t.sink(stream, state, K.embedding_changes).awaitTermination()
    assert t.committed() == [0, 1, 2]
    old, new, skipped = steps
    want = R.upsert(R.upsert(old, new, key), skipped, key, ["embedding_status"])
    assert sorted(map(tuple, t.read().collect())) == sorted(map(tuple, want.select(t.columns).collect()))


def test_notifications_over_batches_in_any_order(spark, sf_dir, tmp_path):
    """Events in three batches that overlap, a replayed one and a table told before: each once."""
    events = R.notification_events(X.classification(spark, sf_dir), X.documents(spark, sf_dir), X.ownership(spark, sf_dir)).cache()
    sent = X.sent_notifications(events)
    key = ["user_id", "classification_id", "notification_type"]
    t = K.KeyedTable(spark, f"file://{tmp_path}/t", events.schema, key)
    t.write(-1, K.Change(events.join(sent, key, "left_semi"), K.INSERT))
    for batch, part in enumerate(("classification_id % 2 = 1", "classification_id % 3 > 0", "true")):
        t.write(batch, *K.notification_changes(events.filter(part)))
        t.write(batch, *K.notification_changes(events.withColumn("title", F.lit("twice"))))
    got = sorted((tuple(r) for r in t.read().collect()), key=repr)
    assert got == sorted((tuple(r) for r in events.select(t.columns).collect()), key=repr) and got


def test_only_committed_folders_are_read(spark, tmp_path):
    t = table(spark, tmp_path)
    t.write(0, K.Change(rows(spark, (1, "a", "b"))))
    t._write(rows(spark, (2, "lost", "lost")), 1, 0, K.UPSERT)
    assert now(t) == [(1, "a", "b")] and t.deltas(0).collect() == []
    files = t.deltas().inputFiles()
    assert files and all("_batch=0/" in f for f in files)
