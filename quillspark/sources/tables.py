"""The engine's tables by name: created empty, appended to, and files copied beside them."""

from __future__ import annotations

import mimetypes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .. import schemas
from ..session import place

TABLES: dict[str, StructType] = {
    "document_metadata": schemas.DOCUMENT_METADATA, "classification_docs": schemas.CLASSIFICATION_DOCS, "document_embeddings": schemas.DOCUMENT_EMBEDDINGS, "document_ownership": schemas.OWNERSHIP,
    "notifications": schemas.NOTIFICATIONS, "audit_logs": schemas.AUDIT_LOGS, "users": schemas.USERS,
}


#: The column by which tables meet, and by which their rows are looked up.
KEY = "document_id"


def create_tables(spark: SparkSession, database: str, buckets: int | None = None) -> None:
    """Every table that isn't there yet, as Parquet. buckets: of tables with a document, as many, sorted by document."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, schema in TABLES.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            writer = spark.createDataFrame([], schema).write.format("parquet")
            if buckets and KEY in schema.names:
                writer = writer.bucketBy(buckets, KEY).sortBy(KEY)
            writer.saveAsTable(f"{database}.{name}")


def bucketed(rows: DataFrame, name: str, key: str = KEY, buckets: int | None = None) -> DataFrame:
    """Rows as a new table in buckets of a key, one sorted file each: joins and groups by the key don't move them again.

    buckets: as many as the session's shuffle partitions if not given; tables to be joined need the same number. A key
    that a large part of all rows has makes a large bucket: ids of documents are spread. Files lie in the shared folder.
    """
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = place(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    # Rows go to the task of their bucket first, so that a bucket is one file and not one for each task.
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def append(rows: DataFrame, database: str, name: str) -> None:
    """Rows appended by column name; columns that they lack are null."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], TABLES[name])
    empty.unionByName(rows, allowMissingColumns=True).select(*TABLES[name].names).write.insertInto(f"{database}.{name}")


def _system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    """A file copied within any store that Hadoop reaches; what is there is replaced."""
    (a, p), (b, q) = _system(spark, source), _system(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, True, spark.sparkContext._jsc.hadoopConfiguration())


def delete_file(spark: SparkSession, path: str) -> bool:
    """Whether there was a file to delete; failures count as none."""
    try:
        fs, p = _system(spark, path)
        return bool(fs.delete(p, False))
    except Exception:
        return False


def content_type(name: str) -> tuple[str, str]:
    """MIME type and a safe file name for a download."""
    return mimetypes.guess_type(name)[0] or "application/octet-stream", name.replace('"', "").replace("\r", "").replace("\n", "")
