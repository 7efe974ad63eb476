"""Listings, deduplication by name, dashboards, reviews, visibility and notifications over the document tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import output_key, percent
from ..schemas import CATEGORIES, MISCELLANEOUS, ORG_SOURCES, REVIEWABLE
from .text_index import TextIndex

# ---- filters and pages


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def where(df: DataFrame, *conditions: Column, **equal: str | None) -> DataFrame:
    """Rows that meet all conditions; a falsy value to compare with is no condition."""
    return df.filter(all_of([*conditions, *[F.col(c) == v for c, v in equal.items() if v]]))


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of an ordered list. The order must end in a unique column, else pages could overlap."""
    df = df.orderBy(*order)
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit is not None else df


def answer(df: DataFrame, order: list[Column], item: Column, limit: int, offset: int = 0) -> DataFrame:
    """A page as one row: total, limit, offset, has_more, and the items in order."""
    # At most `limit` rows, numbered in their order.
    rows = page(df, order, limit, offset).select(F.monotonically_increasing_id().alias("k"), item.alias("item"))
    rows = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]).alias("items"))
    found = total(df).crossJoin(F.broadcast(rows))  # one row each
    return found.select("total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), (F.lit(offset) + F.size("items") < F.col("total")).alias("has_more"), "items")


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def live() -> Column:
    return F.col("processing_status") != "Deleted"


PLACEHOLDERS = frozenset(("string", "str", "example", "test", "<string>", "none", "null", ""))


def real(value: str | None) -> str | None:
    """A filter's value unless it is a placeholder."""
    return None if value is None or value.strip().lower() in PLACEHOLDERS else value


# ---- latest classification


def latest(classification: DataFrame) -> DataFrame:
    """The newest classification of each document; the largest id of equally new ones."""
    w = Window.partitionBy("document_id").orderBy(F.col("current_timestamp_ist").desc(), F.col("classification_id").desc())
    return classification.withColumn("newest", F.row_number().over(w)).filter("newest = 1").drop("newest")


def with_latest(documents: DataFrame, classification: DataFrame, *columns: str) -> DataFrame:
    new = latest(classification).select("document_id", *columns)
    return documents.join(new, "document_id", "left")


# ---- listings


FILE = ("document_id", "file_name", "file_path", "processing_status", "is_duplicate", "duplicate_of", "source_type", "file_size", "current_timestamp_ist")


def files(documents: DataFrame, duplicates_only: bool = False, source_type: str | None = None) -> DataFrame:
    return where(documents, live(), F.col("is_duplicate") == duplicates_only, source_type=source_type).select(*FILE)


def files_with_class(documents: DataFrame, classification: DataFrame, source_type: str | None = None) -> DataFrame:
    return with_latest(where(documents, live(), source_type=source_type).select(*FILE), classification, "classification_id", "document_type", "confidence_score", "classification_status", "classification_tier")


def by_id(documents: DataFrame, document_id: int, originals: bool = False) -> DataFrame:
    """One document, whatever its state; with originals, only if it isn't marked a duplicate."""
    return where(documents, F.col("document_id") == document_id, *([~F.col("is_duplicate")] if originals else [])).select(*FILE)


def duplicates_by_name(documents: DataFrame, name: str) -> DataFrame:
    return where(documents, live(), F.col("is_duplicate"), F.col("file_name") == name).select(*FILE)


def deleted(documents: DataFrame, source_type: str | None = None, name: str | None = None, index: TextIndex | None = None) -> DataFrame:
    """Deleted files, with part of a name if asked. index: of file names; it leaves only likely rows to be tested."""
    if name and index:
        documents = index.search(documents, "document_id", name, ["file_name"])
    conditions = [F.col("file_name").ilike(f"%{name}%")] if name and not index else []
    return where(documents, ~live(), *conditions, source_type=source_type).select(*FILE, "processed_at")


def search_metadata(documents: DataFrame, classification: DataFrame, text: str | None = None, document_type: str | None = None, source_type: str | None = None, index: TextIndex | None = None) -> DataFrame:
    """Live files with a text in their name or path. index: of both columns; it leaves only likely rows to be tested."""
    if text and index:
        documents = index.search(documents, "document_id", text, ["file_name", "file_path"])
    conditions = [F.col("file_name").ilike(f"%{text}%") | F.col("file_path").ilike(f"%{text}%")] if text and not index else []
    found = with_latest(where(documents, live(), *conditions, source_type=source_type).select(*FILE), classification, "document_type", "confidence_score", "classification_status")
    return where(found, document_type=document_type)


# ---- duplicates by name


def _arrival() -> Column:
    return F.struct("current_timestamp_ist", "document_id", "file_path")


def _with_oldest(documents: DataFrame) -> DataFrame:
    """Each row with the number of live rows of its name, `n_live`, and the oldest of them, `oldest`.

    Names are counted before anything moves, and the join back is by key, which Spark splits where one name is hot.
    """
    names = documents.filter(live()).groupBy(F.col("file_name").alias("_name")).agg(F.count(F.lit(1)).alias("n_live"), F.min(_arrival()).alias("oldest"))
    return documents.join(names, F.col("file_name").eqNullSafe(F.col("_name")), "left").drop("_name")


def rescan(documents: DataFrame) -> DataFrame:
    """Of live rows of one name the oldest is the original, the others its duplicates; deleted rows stay as they are.

    A name that occurs once becomes an original unless it already is one or is marked a duplicate, which it keeps.
    Ids are unique.
    """
    group, oldest = live() & (F.col("n_live") > 1), _arrival().eqNullSafe(F.col("oldest"))
    alone = live() & (F.col("n_live") == 1) & ~F.col("processing_status").isin("Original", "Duplicate")
    first, later = (group & oldest) | alone, group & ~oldest
    return _with_oldest(documents).select(*[c for c in documents.columns if c not in ("processing_status", "is_duplicate", "duplicate_of")],
        F.when(first, "Original").when(later, "Duplicate").otherwise(F.col("processing_status")).alias("processing_status"),
        F.when(first, False).when(later, True).otherwise(F.col("is_duplicate")).alias("is_duplicate"),
        F.when(later, F.col("oldest.file_path")).when(~first, F.col("duplicate_of")).alias("duplicate_of"),
    )


def rescan_counts(documents: DataFrame) -> DataFrame:
    """Groups found, rows marked as duplicates and as originals, from the table before the rescan."""
    names = documents.filter(live()).groupBy("file_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("processing_status").isin("Original", "Duplicate")).alias("fresh"))
    groups, single = F.count_if(F.col("n") > 1), F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("fresh"))), F.lit(0))
    return names.agg(groups.alias("duplicate_groups_found"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("records_marked_duplicate"), (groups + single).alias("records_marked_original"))


def arrivals(documents: DataFrame) -> DataFrame:
    """What each file was on arrival: a duplicate of the oldest earlier live file of its name, or an original.

    The oldest live file of all is that file for every later row, and earlier rows have none.
    """
    earlier = F.struct(F.col("oldest.current_timestamp_ist"), F.col("oldest.document_id")) < F.struct("current_timestamp_ist", "document_id")
    first = F.when(F.col("oldest").isNotNull() & earlier, F.col("oldest.file_path"))
    return _with_oldest(documents).select("document_id", "file_name", first.isNotNull().alias("is_duplicate"), first.alias("duplicate_of"))


def duplicate_groups(documents: DataFrame, source_type: str | None = None) -> DataFrame:
    """Names of which one live row at least is a duplicate (even if its original is deleted)."""
    sources = F.array_sort(F.filter(F.collect_set("source_type"), lambda s: s != ""))
    groups = where(documents, live(), source_type=source_type).groupBy("file_name").agg(F.count(F.lit(1)).alias("copy_count"), F.min("current_timestamp_ist").alias("earliest"), F.max("current_timestamp_ist").alias("latest"), sources.alias("sources"), F.count_if("is_duplicate").alias("marked"))
    return groups.filter("marked > 0").drop("marked")


def groups_by_size() -> list[Column]:
    return [F.col("copy_count").desc(), F.col("file_name")]


def numbered(rows: DataFrame, key: str, pieces: dict[str, Column], order: list[str], name: str) -> DataFrame:
    """Number the rows of each key from 1, in order of the pieces and then of `order`.

    pieces: columns that part a key's rows in order. Rows are numbered within a piece and pieces by their sizes, so that a
    key of very many rows is no single task's.
    """
    at = {f"_{c}": piece for c, piece in pieces.items()}
    rows = rows.withColumns(at)
    by = [key, *at]
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy(*at)) - F.col("_n")
    starts = sizes.select(*[F.col(c).alias(f"{c}_of") for c in by], before.alias("_before"))
    within = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    found = within.join(starts, all_of([F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by]))
    return found.withColumn(name, (F.col("_before") + F.col("_k")).cast("int")).drop(*at, *[f"{c}_of" for c in by], "_before", "_k")


def group_copies(documents: DataFrame, source_type: str | None = None) -> DataFrame:
    """The live rows of each group, original first; the source narrows the groups, not their copies."""
    names = duplicate_groups(documents, source_type).select("file_name")
    rows = documents.filter(live()).join(names, "file_name", "left_semi")
    pieces = {"marked": F.col("is_duplicate"), "day": F.date_trunc("day", "current_timestamp_ist")}
    rows = numbered(rows, "file_name", pieces, ["current_timestamp_ist", "document_id"], "copy_no")
    return rows.select("file_name", "copy_no", "document_id", "file_path", "is_duplicate", "duplicate_of", "source_type")


# ---- dashboards


def n_rows(condition: Column | None = None, weight: str | None = None) -> Column:
    """How many rows (that meet a condition) there are. weight: a column that says how many a row stands for."""
    if weight is None:
        return F.count(F.lit(1)) if condition is None else F.count_if(condition)
    n = F.col(weight) if condition is None else F.when(condition, F.col(weight))
    return F.coalesce(F.sum(n), F.lit(0))


def counts(df: DataFrame, weight: str | None = None, **conditions: Column | None) -> DataFrame:
    return df.agg(*[n_rows(c, weight).alias(name) for name, c in conditions.items()])


def _status(name: str) -> Column:
    return F.col("processing_status") == name


def files_summary(documents: DataFrame, weight: str | None = None) -> DataFrame:
    known = ("Original", "Duplicate", "Deleted", "Ingested")
    source = lambda s: F.col("source_type") == s
    return counts(documents, weight, total=None, originals=_status("Original"), duplicates=_status("Duplicate"), deleted=_status("Deleted"), ingested=_status("Ingested"), other=~F.col("processing_status").isin(*known), from_outlook=source("Outlook"), from_sharepoint=source("Sharepoint"), from_manual=source("manual_upload"))


def class_summary(classification: DataFrame) -> DataFrame:
    states = ("auto_classified", "auto_miscellaneous", "soft_flag", "hard_stop", "human_approved", "human_rejected")
    tier = lambda t: F.col("classification_tier") == t
    return counts(classification, total_classified=None, **{s: F.col("classification_status") == s for s in states}, rule_only=tier("rule_only"), ai_assisted=tier("rule_and_ai"), **{c.lower(): F.col("document_type") == c for c in (*CATEGORIES, MISCELLANEOUS)})


def sources(documents: DataFrame, weight: str | None = None) -> DataFrame:
    n = {"total": None, "originals": _status("Original"), "duplicates": _status("Duplicate")}
    rows = documents.filter(live() & F.col("source_type").isNotNull()).groupBy("source_type")
    return rows.agg(*[n_rows(c, weight).alias(name) for name, c in n.items()]).orderBy(F.col("total").desc(), "source_type")


def stats_totals(documents: DataFrame, weight: str | None = None) -> DataFrame:
    return counts(documents.filter(live()), weight, total=None, originals=_status("Original"), duplicates=_status("Duplicate"))


def stats_by_source(documents: DataFrame, weight: str | None = None) -> DataFrame:
    return sources(documents, weight).select("source_type", F.col("originals").alias("original"), F.col("duplicates").alias("duplicate"))


def stats_by_day(documents: DataFrame, as_of: str, zone: str = "Asia/Kolkata", days: int = 30, weight: str | None = None) -> DataFrame:
    """Rows (deleted ones too) of each local day since `days` before `as_of`; days without rows don't appear."""
    ts = F.col("current_timestamp_ist").cast("timestamp")
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return documents.filter(ts >= since).groupBy(F.to_date(F.from_utc_timestamp(ts, zone)).alias("date")).agg(n_rows(weight=weight).alias("count")).orderBy("date")


# ---- classification and reviews


def queue(documents: DataFrame, classification: DataFrame) -> DataFrame:
    """Live originals that nothing has classified, oldest first."""
    waiting = documents.filter(live() & ~F.col("is_duplicate")).join(classification, "document_id", "left_anti")
    return waiting.select("document_id", "file_name", "file_path", "source_type", "current_timestamp_ist")


def joined(classification: DataFrame, documents: DataFrame) -> DataFrame:
    return classification.join(documents.select("document_id", "source_type", "file_name", "file_path"), "document_id")


def pending_review(classification: DataFrame, documents: DataFrame, status: str | None = None) -> DataFrame:
    """Flagged rows with how urgent they are and what to do, most confident (and unknown) first."""
    states = (status,) if status in REVIEWABLE else REVIEWABLE
    rows = joined(classification.filter(F.col("classification_status").isin(*states)), documents)
    said = percent(F.col("combined_confidence_score"), 1)
    hard = F.col("classification_status") == "hard_stop"
    # The advice that records carry.
    advice = F.when(hard, F.concat(F.lit("Confidence "), said, F.lit("% is below 40%. Use override_category to manually assign the correct category. Valid categories: Contracts, Compliance, Governance, Certifications, Invoices, Miscellaneous."))).otherwise(
        F.concat(F.lit("Confidence "), said, F.lit("% (between 40-70%). System suggests '"), F.col("document_type"), F.lit("'. Confirm with human_decision=true or supply override_category."))
    )
    out = rows.select("classification_id", "document_id", "source_type", "file_name", F.col("document_type").alias("suggested_category"), F.col("combined_confidence_score").alias("confidence_score"), "classification_status", F.when(hard, "mandatory").otherwise("recommended").alias("review_urgency"), advice.alias("review_guidance"))
    return out.orderBy(F.col("confidence_score").desc_nulls_first(), "classification_id")


def unfinalized(classification: DataFrame, documents: DataFrame, document_type: str | None = None, status: str | None = None, source_type: str | None = None) -> DataFrame:
    """Flagged rows with a type that no output holds yet."""
    states = (status,) if status in REVIEWABLE else REVIEWABLE
    rows = joined(classification.filter(F.col("document_type").isNotNull() & F.col("output_document_path").isNull() & F.col("classification_status").isin(*states)), documents)
    return where(rows, document_type=document_type, source_type=source_type)


def results(classification: DataFrame, documents: DataFrame, document_type: str | None = None, status: str | None = None, tier: str | None = None, source_type: str | None = None) -> DataFrame:
    rows = joined(classification, documents)
    return where(rows, document_type=document_type, classification_status=status, classification_tier=tier, source_type=source_type)


def batch_rollup(classified: DataFrame) -> DataFrame:
    state = lambda s: F.col("classification_status") == s
    tier = lambda t: F.col("classification_tier") == t
    return counts(classified, total_processed=None, auto_classified=state("auto_classified"), auto_miscellaneous=state("auto_miscellaneous"), soft_flag=state("soft_flag"), hard_stop=state("hard_stop"), rule_only=tier("rule_only"), ai_assisted=tier("rule_and_ai"))


def review(classification: DataFrame, documents: DataFrame, decisions: DataFrame) -> DataFrame:
    """Flagged rows after decisions (classification_id, human_decision, reviewed_by, override_category).

    Approval takes a valid override, else the suggestion; an invalid override counts for nothing. Rejection files the
    document under Miscellaneous. Rows that aren't flagged don't change and don't appear.
    """
    rows = joined(classification.filter(F.col("classification_status").isin(*REVIEWABLE)), documents).drop("human_decision", "reviewed_by").join(decisions, "classification_id")
    yes = F.col("human_decision")
    category = F.when(yes, F.when(F.col("override_category").isin(*CATEGORIES, MISCELLANEOUS), F.col("override_category")).otherwise(F.col("document_type"))).otherwise(MISCELLANEOUS)
    # Fixed value: the note of a rejection.
    note = F.when(~yes, F.concat(F.lit("Rejected by reviewer '"), F.col("reviewed_by"), F.lit("'. System had suggested '"), F.col("document_type"), F.lit("'. Routed to Miscellaneous by reviewer decision.")))
    return rows.select("classification_id", "document_id", category.alias("document_type"), output_key(category, F.col("file_path")).alias("output_document_path"), F.when(yes, "human_approved").otherwise("human_rejected").alias("classification_status"), yes.alias("human_decision"), "reviewed_by", note.alias("classification_notes"))


# ---- visibility, audit, notifications


def visible(documents: DataFrame, ownership: DataFrame, user_id: str | None = None, admin: bool = False) -> DataFrame:
    """What a user may see: files of the organisation's sources and their own uploads; an admin sees all."""
    rows = documents.filter(live())
    if admin:
        return rows
    own = ownership.filter(F.col("user_id") == user_id).select("document_id").distinct()
    marked = rows.join(own.withColumn("own", F.lit(True)), "document_id", "left")
    return marked.filter(F.col("source_type").isin(*ORG_SOURCES) | ((F.col("source_type") == "manual_upload") & F.col("own"))).drop("own")


def user_documents(documents: DataFrame, classification: DataFrame, ownership: DataFrame, user_id: str | None = None, admin: bool = False, source_type: str | None = None, document_type: str | None = None, status: str | None = None, text: str | None = None) -> DataFrame:
    conditions = [F.col("file_name").ilike(f"%{text}%")] if text else []
    rows = where(visible(documents, ownership, user_id, admin), *conditions, source_type=source_type).select("document_id", "file_name", "source_type", "processing_status", "current_timestamp_ist")
    found = with_latest(rows, classification, "document_type", "classification_status", "combined_confidence_score").withColumnRenamed("combined_confidence_score", "confidence_score")
    return where(found, document_type=document_type, classification_status=status)


def audit(logs: DataFrame, users: DataFrame, action: str | None = None, resource_type: str | None = None, user_id: str | None = None) -> DataFrame:
    return where(logs, action=action, resource_type=resource_type, user_id=user_id).join(users.select("user_id", "email", "full_name"), "user_id", "left")


NOTICE = ("user_id", "classification_id", "notification_type")


def notification_events(classification: DataFrame, documents: DataFrame, ownership: DataFrame) -> DataFrame:
    """What owners of manual uploads should hear of: one row for each user, classification and type."""
    rows = classification.join(documents.filter(F.col("source_type") == "manual_upload").select("document_id", "file_name"), "document_id").join(ownership.filter(F.col("user_id").isNotNull()).select("document_id", "user_id"), "document_id")
    return notices(rows).dropDuplicates([*NOTICE])


def notices(rows: DataFrame) -> DataFrame:
    """What to tell of each classification with its file's name and an owner; statuses that nobody is told of go."""
    status, name, score = F.col("classification_status"), F.col("file_name"), percent(F.col("combined_confidence_score"))
    flagged = status.isin(*REVIEWABLE)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    # Types, titles and messages.
    kind = F.when(flagged, "document_in_review").when(status == "auto_classified", "document_classified").when(status == "human_approved", "document_approved").when(status == "human_rejected", "document_rejected")
    title = F.when(flagged, "Your document is under review").when(status == "auto_classified", "Document classified").when(status == "human_approved", "Document approved").when(status == "human_rejected", "Document sent to Miscellaneous")
    message = (
        F.when(flagged, text('"', name, '" has been flagged for human review (confidence ', score, "%). An admin will review it shortly."))
        .when(status == "auto_classified", text('"', name, '" was automatically classified as ', F.col("document_type"), " (", score, "% confidence)."))
        .when(status == "human_approved", text('"', name, '" was reviewed and approved as ', F.col("document_type"), " by an admin."))
        .when(status == "human_rejected", text('"', name, '" was reviewed and could not be classified into a specific category. It has been moved to Miscellaneous.'))
    )
    return rows.select("user_id", kind.alias("notification_type"), title.alias("title"), message.alias("message"), "document_id", "classification_id").filter("notification_type IS NOT NULL")


def pending_notifications(events: DataFrame, sent: DataFrame) -> DataFrame:
    return events.join(sent, ["user_id", "classification_id", "notification_type"], "left_anti")


def unread(notifications: DataFrame) -> DataFrame:
    return notifications.filter(~F.col("is_read")).groupBy("user_id").agg(F.count(F.lit(1)).alias("unread"))


def marked_read(notifications: DataFrame, user_id: str, keys: list | None = None) -> DataFrame:
    """All notifications, those of a user (or some of them by classification) read."""
    mine = F.col("user_id") == user_id
    return notifications.withColumn("is_read", F.col("is_read") | (mine if keys is None else mine & F.col("classification_id").isin(*keys)))


def health(services: DataFrame) -> DataFrame:
    """services: name and status. One row: healthy only if all are; no services are healthy."""
    well = F.col("status").eqNullSafe(F.lit("healthy"))
    rows = services.agg(F.coalesce(F.every(well), F.lit(True)).alias("well"), F.count(F.lit(1)).alias("services"), F.count_if(~well).alias("degraded"))
    return rows.select(F.when(F.col("well"), "healthy").otherwise("degraded").alias("overall"), "services", "degraded")


# ---- keyed writes


def seed(table: DataFrame, first: DataFrame) -> DataFrame:
    """Rows to append to a table that must not be empty: `first` if it is, else none."""
    return first.join(table.select(F.lit(1)).limit(1), F.lit(True), "left_anti")


def insert_missing(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows to append: those of `new` whose key the table hasn't; of equal keys one."""
    return new.dropDuplicates(key).join(table.select(*key), key, "left_anti")


def upsert(table: DataFrame, new: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """The table with rows of `new` put in by key; with columns, only those change in rows that are there."""
    old, fresh = table.alias("o"), new.dropDuplicates(key).withColumn("_new", F.lit(True)).alias("n")
    both = old.join(fresh, key, "full_outer")
    change = set(columns if columns is not None else new.columns)
    there = F.col("n._new").isNotNull()
    known = F.coalesce(*[F.col(f"o.{c}").cast("string") for c in table.columns if c not in key]).isNotNull() if columns is not None else F.lit(False)
    pick = lambda c: F.col(c) if c in key else F.when(there & (~known | F.lit(c in change)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")
    return both.select(*[pick(c).alias(c) for c in table.columns])


def soft_delete(documents: DataFrame, ids: list[int]) -> DataFrame:
    return documents.withColumn("processing_status", F.when(F.col("document_id").isin(*ids), "Deleted").otherwise(F.col("processing_status")))
