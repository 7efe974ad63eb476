"""The engine's tables derived from the driver's, so that every query has rows of all its cases.

The expressions stand for an ingest history: which source a file came from, when, and what reviewers decided. They are
the same in SQL in `oracle.py`. Every vector takes part, but all belong to the documents 0 to 99, as FIXTURES.md and the
SQL have it; chunk texts are empty where chunks outrun the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import rescan
from ..schemas import CATEGORIES, MISCELLANEOUS

STATUSES = ("auto_classified", "soft_flag", "hard_stop", "human_approved", "human_rejected", "auto_miscellaneous")
TYPES = (*CATEGORIES, MISCELLANEOUS)
SOURCES = ("Outlook", "Sharepoint", "manual_upload", "rdbms", "rdbms_flow")
KINDS = ("invoice", "contract", "audit", "board", "certificate", "invoice_contract")
AS_OF = "2024-02-12 00:00:00"

#: Keywords and substrings that the driver's invented prose holds; fixed values.
CORPUS_RULES = {
    "Contracts": {"keywords": ["ther", "thon", "than", "thes", "erin", "thor"], "sentences": ["tion", "ing the"], "filename_patterns": [r"\bcontract\b"]},
    "Compliance": {"keywords": ["thth", "thre", "thed", "thea", "eren", "then"], "sentences": ["ment", "er of"], "filename_patterns": [r"\baudit\b"]},
    "Governance": {"keywords": ["thnt", "thhe", "thble", "thin", "erer", "thing"], "sentences": ["ble", "on the"], "filename_patterns": [r"\bboard\b"]},
    "Certifications": {"keywords": ["thha", "anea", "thti", "eron", "thnd", "erst"], "sentences": ["ou", "and the"], "filename_patterns": [r"\bcertificate\b"]},
    "Invoices": {"keywords": ["thtion", "thly", "thsh", "thst", "thou", "erre"], "sentences": ["nd the", "in the"], "filename_patterns": [r"\binvoice\b"]},
}
CORPUS_BASELINE = 25.0


def _pick(values: tuple, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digit(text: Column, at: int = 1) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), at, 1), 16, 10).cast("int")


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_metadata before any duplicate is marked."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    kind = F.coalesce(_pick(KINDS, _digit(text)), F.lit("report"))
    source = _pick(SOURCES, F.col("doc_id") % 6)
    d = d.select(F.col("doc_id").alias("document_id"), F.concat(kind, F.lit("_"), F.substring(F.md5(text.cast("binary")), 1, 12), F.lit(".pdf")).alias("file_name"), source.alias("source_type"), F.col("n_chars").alias("file_size"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id * 61 AS INT), 0)").alias("current_timestamp_ist"))
    path = F.concat(F.lit("/src/"), F.coalesce("source_type", F.lit("unknown")), F.lit("/"), F.substring(F.md5(F.col("document_id").cast("string").cast("binary")), 1, 12), F.lit("/"), F.col("file_name"))
    status = F.when(F.col("document_id") % 17 == 0, "Deleted").when(F.col("document_id") % 13 == 0, "Ingested").otherwise("In Progress")
    return d.select("*", path.alias("file_path"), status.alias("processing_status"), F.lit(False).alias("is_duplicate"), F.lit(None).cast("string").alias("duplicate_of"), F.lit(None).cast("timestamp_ntz").alias("processed_at"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescan(arrivals(spark, sf_dir))


def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live originals but for those that still wait; some are classified twice."""
    base = documents(spark, sf_dir).filter("NOT is_duplicate AND processing_status <> 'Deleted' AND document_id % 5 <> 0")
    again = F.when(F.col("document_id") % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = base.select("document_id", "file_path", "current_timestamp_ist", F.explode(again).alias("k"))
    d = F.col("document_id")
    status = _pick(STATUSES, (d + F.col("k")) % 6)
    kind = _pick(TYPES, (d + 2 * F.col("k")) % 6)
    score = ((d * 37 + F.col("k")) % 101).cast("double")
    return rows.select(
        (d * 10 + F.col("k")).alias("classification_id"), "document_id", status.alias("classification_status"), kind.alias("document_type"), score.alias("combined_confidence_score"), score.alias("confidence_score"),
        F.when(d % 3 == 0, "rule_only").otherwise("rule_and_ai").alias("classification_tier"), F.when(status.isin("soft_flag", "hard_stop"), F.lit(None).cast("string")).otherwise(F.concat(F.lit("DIC/"), kind)).alias("output_document_path"),
        F.lit(None).cast("boolean").alias("human_decision"), F.lit(None).cast("string").alias("reviewed_by"), (F.col("current_timestamp_ist") + F.expr("make_dt_interval(k, 0, 0, 0)")).alias("current_timestamp_ist"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    e = e.select(F.col("vec_id").alias("embedding_id"), (F.col("vec_id") % 100).alias("document_id"), F.floor(F.col("vec_id") / 100).cast("int").alias("chunk_index"), F.when(F.col("vec_id") % 29 != 0, F.col("embedding")).alias("embedding"), F.when(F.col("vec_id") % 29 == 0, "failed").otherwise("generated").alias("embedding_status"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return e.join(texts, "document_id").select("*", F.substring(F.col("text"), F.lit(1) + 200 * F.col("chunk_index"), F.lit(200)).alias("chunk_text")).drop("text")


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("query"))


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = arrivals(spark, sf_dir).filter("source_type = 'manual_upload'")
    return d.select("document_id", F.when(F.col("document_id") % 4 != 0, F.concat(F.lit("u"), (F.col("document_id") % 5).cast("string"))).alias("user_id"))


def ai_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers; none where it failed."""
    d = table(spark, sf_dir, "documents").filter("doc_id % 23 <> 0")
    category = F.coalesce(_pick(TYPES, _digit(F.col("doc_id").cast("string"), 3)), F.lit(TYPES[0]))
    return d.select(F.col("doc_id").alias("document_id"), category.alias("ai_category"), ((F.col("doc_id") * 37) % 101).cast("double").alias("ai_score"), F.lit("by its text").alias("ai_reasoning"))


def item_rules(spark: SparkSession, sf_dir: str) -> dict:
    """A rule set, as a file of rules would hold it: words of benchmark items and runs of three, by their lengths in five categories."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    runs = F.when(F.size("w") > 2, F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "benchmark").select(words.alias("w"))
    each = lambda name, of: rows.select(F.lit(name).alias("kind"), F.explode(of).alias("pattern")).distinct()
    said = each("keywords", F.col("w")).unionByName(each("sentences", runs)).orderBy("kind", "pattern").collect()
    return {c: {k: [r.pattern for r in said if r.kind == k and len(r.pattern) % 5 == i] for k in ("keywords", "sentences")} for i, c in enumerate(CATEGORIES)}


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service for each type of event, degraded where one of its events has no value above 0."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name"))
    return e.agg(F.when(F.min("value") > 0, "healthy").otherwise("degraded").alias("status"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those who caused events, but for one in six."""
    who = (F.col("user_id") % 60).cast("string")
    rows = table(spark, sf_dir, "events").filter("user_id % 60 < 50").select(who.alias("n")).distinct()
    return rows.select(F.concat(F.lit("u"), "n").alias("user_id"), F.concat(F.lit("user"), "n", F.lit("@example.org")).alias("email"), F.concat(F.lit("User "), "n").alias("full_name"))


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("log_id"), F.concat(F.lit("u"), (F.col("user_id") % 60).cast("string")).alias("user_id"), F.col("event_type").alias("action"), F.lit("document").alias("resource_type"), F.col("props").alias("details"), F.col("ts").alias("created_at"))


def sent_notifications(events: DataFrame) -> DataFrame:
    """Of the events, those that were told before."""
    return events.filter("classification_id % 3 = 0").select("user_id", "classification_id", "notification_type")


#: Blocks of a printed page, and points from one to the next.
PAGE_LINES, LINE = 48, 20


def _page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", F.posexplode(F.split(F.coalesce("html", F.lit("")), "<")).alias("i", "line"))
    return rows.select("doc_id", "url", "line", F.floor(F.col("i") / PAGE_LINES).cast("int").alias("page"), (F.col("i") % PAGE_LINES).alias("k"), F.length("line").alias("n"))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text after each tag as a block of printed pages; block 5 of each is the address."""
    x0, y0 = 10.0 + F.col("n") % 5 * 60, 10.0 + F.col("k") * LINE
    text = F.when(F.col("k") == 5, F.col("url")).otherwise(F.regexp_replace("line", "^[^>]*>", ""))
    rows = _page_lines(spark, sf_dir)
    return rows.select("doc_id", "page", F.col("k").alias("block_no"), F.lit(1000.0).alias("height"), x0.alias("x0"), y0.alias("y0"), (x0 + 100).alias("x1"), (y0 + 8 + F.col("n") % 3 * 4).alias("y1"), text.alias("text"))


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table beside each tag that is, with its text, a multiple of 11 long."""
    cells = F.array(F.array(F.lit("Kind"), F.concat(F.lit("k"), F.substring(F.md5(F.col("line").cast("binary")), 1, 6))))
    rows = _page_lines(spark, sf_dir).filter("n % 11 = 0")
    return rows.select("doc_id", "page", F.col("k").alias("table_no"), F.lit(250.0).alias("x0"), (12.0 + F.col("k") * LINE).alias("y0"), F.lit(400.0).alias("x1"), (45.0 + F.col("k") * LINE).alias("y1"), cells.alias("rows"))
