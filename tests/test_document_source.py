import os

import pytest

from quillspark.sources import document_source as D
from quillspark.sources import files
from tests.test_sources import DOC, make, p


@pytest.fixture
def folder(spark, tmp_path):
    D.register(spark)
    (tmp_path / "in/deep").mkdir(parents=True)
    for k, (name, data) in enumerate([("a.docx", DOC), ("deep/b.docx", make(p("Two"))), ("broken.docx", b"no zip"), ("old.doc", b"old"), ("empty.docx", b""), ("_SUCCESS", b"")]):
        put(tmp_path / "in", name, data, k)
    return tmp_path / "in"


def put(folder, name, data, at):
    (folder / name).write_bytes(data)
    os.utime(folder / name, (1_700_000_000 + at, 1_700_000_000 + at))


def rows(df):
    return sorted((r.file_name, r.text, len(r.chunks), r.error_kind) for r in df.collect())


def test_batch_equals_the_file_reader(spark, folder):
    got = rows(files.finished(spark.read.format(D.NAME).load(str(folder))))
    # Spark's own reader of binary files leaves out empty ones.
    assert [x for x in got if x[0] != "empty.docx"] == [x for x in rows(files.extracted(files.read_files(spark, str(folder)))) if x[0] != "_SUCCESS"]
    assert [(x[0], x[3]) for x in got] == [("a.docx", None), ("b.docx", None), ("broken.docx", "failed"), ("empty.docx", "failed"), ("old.doc", "unsupported")]


def test_partitions_by_bytes(spark, folder):
    sizes = [D.File(k, str(k), n) for k, n in enumerate([5, 5, 20, 1, 9, 1, 0])]
    assert [[f.size for f in x.files] for x in D.packed(sizes, 10)] == [[5, 5], [20], [1, 9], [1, 0]] and D.packed([], 10) == []
    parts = lambda n: spark.read.format(D.NAME).option("bytes", n).load(str(folder)).rdd.getNumPartitions()
    assert parts(1) >= 3 and parts(1 << 20) == 1


def test_columns_that_need_no_file_open_none(spark, folder):
    source = spark.read.format(D.NAME)
    gone = D.Reader(source.load(str(folder)).select("file_name", "file_size").schema, {"path": str(folder)})
    (part,) = gone.partitions()
    for f in part.files:
        os.unlink(f.path)
    assert sorted(gone.read(part))[0] == ("a.docx", len(DOC))
    lost = list(D.Reader(source.load(str(folder)).select("file_name", "error_kind").schema, {"path": str(folder)}).read(part))
    assert len(lost) == 5 and {x[1] for x in lost} == {"failed"}


def test_some_columns_and_wrong_ones(spark, folder):
    assert sorted(map(tuple, spark.read.format(D.NAME).schema("file_size long, file_name string").load(str(folder)).filter("file_name = 'old.doc'").collect())) == [(3, "old.doc")]
    assert {bytes(r.content) for r in spark.read.format(D.NAME).schema("content binary").load(str(folder)).collect()} >= {b"old", DOC}
    with pytest.raises(Exception, match="no column colour"):
        spark.read.format(D.NAME).schema("colour string").load(str(folder)).collect()
    assert spark.read.format(D.NAME).load(str(folder / "none")).count() == 0


def test_a_stream_gives_the_batch_and_goes_on(spark, folder, tmp_path):
    def run(settle=0):
        stream = spark.readStream.format(D.NAME).option("settle", settle).load(str(folder))
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").start(f"{tmp_path}/out")
        query.processAllAvailable()
        query.stop()
        return rows(files.finished(spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")))

    assert run(10**10) == []  # nothing is old enough
    first = run()
    assert first == rows(files.finished(spark.read.format(D.NAME).load(str(folder)))) and len(first) == 5
    put(folder, "same.docx", make(p("Same moment")), 4)
    put(folder, "late.docx", make(p("Late")), 9)
    assert run() == rows(files.finished(spark.read.format(D.NAME).load(str(folder)))) and len(run()) == 7
