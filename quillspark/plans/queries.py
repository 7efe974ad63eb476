"""Every query by name: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, scoring, text, vectors
from ..operators import page_layout as L
from ..operators import relational as R
from ..operators import retrieval as V
from ..operators.page_index import PageIndex
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from ..providers import SourceWriter
from ..session import place
from ..sources.tables import bucketed
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
RULES = scoring.Rules.of(X.CORPUS_RULES, X.CORPUS_BASELINE)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return X.documents(s, d), X.classification(s, d)


def newest() -> list:
    return [F.col("current_timestamp_ist").desc(), F.col("document_id")]


@query
def semantic_search(s, d):
    docs, cls = _tables(s, d)
    return V.search(X.embeddings(s, d), docs, cls, X.query_vector(s, d))


@query
def semantic_search_filtered(s, d):
    docs, cls = _tables(s, d)
    return V.search(X.embeddings(s, d), docs, cls, X.query_vector(s, d), document_type="Contracts", status="string")


@query
def semantic_search_fallback(s, d):
    docs, cls = _tables(s, d)
    return V.search(X.embeddings(s, d), docs, cls, X.query_vector(s, d), document_type="Unknown kind", source_type="Outlook")


@query
def qa_context(s, d):
    return V.context(semantic_search(s, d))


@query
def qa_answer(s, d):
    """What a writer says to a question about the documents found for it."""
    rows = qa_context(s, d).select(F.lit("What is agreed?").alias("question"), "context")
    return V.answered(rows, SourceWriter).select("question", "answer", "answer_status")


def _scored(s, d):
    return V.scored(X.embeddings(s, d).crossJoin(F.broadcast(X.query_vector(s, d))), F.col("query"))


@query
def vector_topk(s, d):
    return V.top(_scored(s, d)).select("embedding_id", "document_id", "chunk_index", F.round("similarity", 4).alias("similarity"))


@query
def vector_threshold(s, d):
    return V.at_least(_scored(s, d), 0.2).select("embedding_id", "document_id", F.round("similarity", 4).alias("similarity"))


@query
def embedding_inventory(s, d):
    return V.inventory(X.embeddings(s, d), X.documents(s, d))


@query
def embedding_state(s, d):
    docs, cls = _tables(s, d)
    return V.state(X.embeddings(s, d), docs, cls)


def _embedding_steps(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every vector anew for documents under 50, with a marker on chunk 0 of those skipped."""
    old = X.embeddings(s, d).select("document_id", "chunk_index", "chunk_text", "embedding_status")
    new = old.filter("document_id < 50").withColumns({"chunk_text": F.concat(F.lit("new "), "chunk_text"), "chunk_index": F.col("chunk_index") + 1, "embedding_status": F.lit("generated")})
    skipped = old.filter("chunk_index = 0 AND document_id % 7 = 0").withColumns({"embedding_status": F.lit("skipped_miscellaneous"), "chunk_text": F.lit("")})
    return old, new, skipped


@query
def embedding_upsert(s, d):
    old, new, skipped = _embedding_steps(s, d)
    return R.upsert(R.upsert(old, new, ["document_id", "chunk_index"]), skipped, ["document_id", "chunk_index"], ["embedding_status"])


@query
def stream_embedding_upsert(s, d):
    """The same, as chunks come in a stream of three batches into a keyed table."""
    from ..streaming.streams import embedding_table

    return embedding_table(*_embedding_steps(s, d)).read()


@query
def files_list(s, d):
    return R.page(R.files(X.documents(s, d), source_type="Outlook"), newest())


@query
def files_duplicates_list(s, d):
    return R.page(R.files(X.documents(s, d), duplicates_only=True), newest(), 100, 5)


def _paged(s, rows) -> PageIndex:
    return PageIndex.build(rows, newest(), place(s, "pages"))


@query
def files_duplicates_list_indexed(s, d):
    """The same page through an index of positions, which reads the files that hold it alone."""
    return _paged(s, R.files(X.documents(s, d), duplicates_only=True)).page(100, 5)


@query
def files_list_deep(s, d):
    """The page half way down the list of all files, through the same index."""
    index = _paged(s, R.files(X.documents(s, d)))
    return index.page(20, index.total().first()[0] // 2)


@query
def files_all_latest_class(s, d):
    return R.page(R.files_with_class(*_tables(s, d)), newest())


@query
def files_summary(s, d):
    return R.files_summary(X.documents(s, d))


@query
def document_by_id(s, d):
    return R.by_id(X.documents(s, d), 34)


@query
def document_to_classify(s, d):
    """One document if it is no duplicate, with the time it came in as text."""
    return R.by_id(X.documents(s, d), 42, originals=True).select("document_id", "file_name", "source_type", text.timestamp_text(F.col("current_timestamp_ist")).alias("ingested_at"))


@query
def files_duplicates_by_name(s, d):
    """The duplicates of the first name that has any."""
    docs = X.documents(s, d)
    name = R.group_copies(docs).agg(F.min("file_name").alias("file_name"))
    return R.files(docs, duplicates_only=True).join(F.broadcast(name), "file_name", "left_semi").orderBy("current_timestamp_ist", "document_id")  # one row


@query
def files_deleted(s, d):
    rows = R.deleted(X.documents(s, d), name="INVOICE")
    return R.page(rows, [F.col("processed_at").desc_nulls_last(), *newest()])


@query
def files_deleted_answer(s, d):
    """A page of deleted files with its totals, as a listing answers."""
    rows = R.answer(R.deleted(X.documents(s, d)), [F.col("processed_at").desc_nulls_last(), *newest()], F.col("document_id").cast("string"), 7, 2)
    return rows.withColumn("items", F.array_join("items", ","))


@query
def duplicate_groups_page(s, d):
    """Groups by size and name, with their earliest and latest time as ISO text."""
    rows = R.page(R.duplicate_groups(X.documents(s, d)), R.groups_by_size(), 10, 3)
    return rows.select("file_name", "copy_count", text.iso_text(F.col("earliest")).alias("earliest"), text.iso_text(F.col("latest")).alias("latest"), F.array_join("sources", ",").alias("sources"))


@query
def duplicate_groups(s, d):
    return R.duplicate_groups(X.documents(s, d)).withColumn("sources", F.array_join("sources", ","))


@query
def duplicate_group_copies(s, d):
    return R.group_copies(X.documents(s, d), "Outlook")


@query
def duplicate_group_count(s, d):
    return R.total(R.duplicate_groups(X.documents(s, d)))


@query
def dedup_rescan(s, d):
    return R.rescan(X.arrivals(s, d)).select("document_id", "file_name", "processing_status", "is_duplicate", "duplicate_of")


@query
def dedup_rescan_counts(s, d):
    return R.rescan_counts(X.arrivals(s, d))


@query
def ingest_dup_check(s, d):
    return R.arrivals(X.arrivals(s, d))


@query
def ingest_insert_missing(s, d):
    """Files to add when those of Outlook are there already."""
    docs = X.arrivals(s, d)
    return R.insert_missing(docs.filter("source_type = 'Outlook'"), docs, ["file_path"]).select("document_id", "file_path")


@query
def soft_delete(s, d):
    return R.soft_delete(X.documents(s, d), [1, 2, 3, 5, 8]).groupBy("processing_status").agg(F.count(F.lit(1)).alias("n"))


@query
def sources(s, d):
    return R.sources(X.documents(s, d))


@query
def stats_totals(s, d):
    return R.stats_totals(X.documents(s, d))


@query
def stats_by_source(s, d):
    return R.stats_by_source(X.documents(s, d))


@query
def stats_by_day(s, d):
    return R.stats_by_day(X.documents(s, d), X.AS_OF)


@query
def metadata_search(s, d):
    docs, cls = _tables(s, d)
    return R.page(R.search_metadata(docs, cls, "contract", document_type="Contracts"), newest())


def _name_index(s, docs) -> TextIndex:
    return TextIndex.build(docs.select("document_id", "file_name", "file_path"), "document_id", ["file_name", "file_path"], place(s, "name-index"))


@query
def files_deleted_indexed(s, d):
    """The same page through an index of the names' trigrams."""
    docs = X.documents(s, d)
    rows = R.deleted(docs, name="INVOICE", index=_name_index(s, docs))
    return R.page(rows, [F.col("processed_at").desc_nulls_last(), *newest()])


@query
def metadata_search_indexed(s, d):
    docs, cls = _tables(s, d)
    return R.page(R.search_metadata(docs, cls, "contract", document_type="Contracts", index=_name_index(s, docs)), newest())


@query
def metadata_search_wildcards(s, d):
    """Part of a path with wildcards of its own: one letter, and any letters."""
    docs, cls = _tables(s, d)
    return R.page(R.search_metadata(docs, cls, "Outl_ok/%_a%.PDF", index=_name_index(s, docs)), newest())


@query
def class_queue(s, d):
    return R.queue(*_tables(s, d)).orderBy("current_timestamp_ist", "document_id")


@query
def class_queue_count(s, d):
    return R.queue(*_tables(s, d)).agg(F.count(F.lit(1)).alias("queue_count"))


@query
def pending_review(s, d):
    docs, cls = _tables(s, d)
    return R.pending_review(cls, docs)


def _laid_out(s, d) -> tuple[DataFrame, DataFrame]:
    """Both tables in buckets of their documents."""
    docs, cls = _tables(s, d)
    return bucketed(docs, "documents"), bucketed(cls, "classification")


@query
def document_by_id_bucketed(s, d):
    """One document out of its bucket."""
    return R.by_id(bucketed(X.documents(s, d), "documents"), 34)


@query
def files_all_latest_class_bucketed(s, d):
    """The same over tables in buckets: neither the newest classification nor the join moves a row to its document."""
    return R.page(R.files_with_class(*_laid_out(s, d)), newest())


@query
def pending_review_bucketed(s, d):
    docs, cls = _laid_out(s, d)
    return R.pending_review(cls, docs)


def _brief(df: DataFrame) -> DataFrame:
    return df.select("classification_id", "document_id", "file_name", "source_type", "document_type", "classification_status", "classification_tier", "combined_confidence_score")


@query
def unfinalized(s, d):
    docs, cls = _tables(s, d)
    return _brief(R.unfinalized(cls, docs, status="soft_flag"))


@query
def unfinalized_page_counts(s, d):
    docs, cls = _tables(s, d)
    rows = R.page(R.unfinalized(cls, docs), [F.col("current_timestamp_ist").desc(), F.col("classification_id")], 100)
    state = lambda x: F.col("classification_status") == x
    return R.counts(rows, on_page=None, soft_flag=state("soft_flag"), hard_stop=state("hard_stop"))


@query
def class_results(s, d):
    docs, cls = _tables(s, d)
    return _brief(R.results(cls, docs, tier="rule_and_ai", source_type="Sharepoint"))


@query
def class_summary(s, d):
    return R.class_summary(X.classification(s, d))


@query
def review_apply(s, d):
    docs, cls = _tables(s, d)
    i = F.col("classification_id")
    decisions = cls.select("classification_id", (i % 4 != 0).alias("human_decision"), F.concat(F.lit("r"), (i % 3).cast("string")).alias("reviewed_by"), F.when(i % 3 == 0, "Invoices").when(i % 3 == 1, "No such category").alias("override_category"))
    return R.review(cls, docs, decisions)


@query
def visible_documents_user(s, d):
    return R.visible(X.documents(s, d), X.ownership(s, d), "u1").select("document_id", "source_type")


@query
def visible_documents_admin(s, d):
    return R.visible(X.documents(s, d), X.ownership(s, d), admin=True).select("document_id", "source_type")


@query
def user_documents(s, d):
    docs, cls = _tables(s, d)
    return R.user_documents(docs, cls, X.ownership(s, d), "u2", status="auto_classified", text="report")


@query
def audit_log(s, d):
    return R.audit(X.audit_logs(s, d), X.users(s, d), action="purchase")


@query
def services_health(s, d):
    return R.health(X.services(s, d))


@query
def users_seeded(s, d):
    """A first user for an empty table; none for one that has users."""
    users = X.users(s, d)
    first = users.agg(F.min("user_id").alias("user_id"))
    seeded = lambda table, name: R.seed(table, first).select(F.lit(name).alias("table_name"), "user_id")
    return seeded(users.filter("user_id IS NULL"), "empty").unionByName(seeded(users, "filled"))


@query
def notifications_events(s, d):
    docs, cls = _tables(s, d)
    return R.notification_events(cls, docs, X.ownership(s, d))


@query
def notifications_pending(s, d):
    events = notifications_events(s, d)
    return R.pending_notifications(events, X.sent_notifications(events))


@query
def unread_counts(s, d):
    rows = notifications_events(s, d).withColumn("is_read", F.col("classification_id") % 2 == 0)
    return R.unread(R.marked_read(rows, "u3"))


@query
def path_keys(s, d):
    docs = X.documents(s, d)
    path = F.concat(F.when(F.col("document_id") % 2 == 0, f"/{text.CONTAINER}").otherwise(""), F.regexp_replace("file_path", "^/src", ""))
    return docs.select("document_id", text.source_key(path).alias("source_key"), text.output_key(F.lit("Contracts"), path).alias("output_key"), text.guid_folder(path).alias("guid_folder"), text.suffix(F.col("file_name")).alias("suffix"), text.stem(F.col("file_name")).alias("stem"))


def _found(s, d, rules=RULES):
    """Signals of each document. Texts are read where they lie; what moves to meet the names is the counts."""
    names = X.arrivals(s, d).select("document_id", "file_name")
    rows = X.table(s, d, "documents").select(F.col("doc_id").alias("document_id"), (F.coalesce("text", F.lit("")) == "").alias("empty"), scoring.text_signals(F.col("text"), rules).alias("texts"))
    return rows.join(names, "document_id").select("document_id", "empty", scoring.joined_signals(F.col("texts"), scoring.name_signals(F.col("file_name"), rules), rules).alias("found"))


@query
def rule_signals(s, d):
    # Outer, since no entry is missing: else Spark would test the array before, and compute it twice.
    return _found(s, d).select("document_id", F.explode_outer("found").alias("x")).select("document_id", "x.category", "x.keywords", "x.sentences", "x.filenames", "x.raw", "x.score")


@query
def rule_signals_automaton(s, d):
    """The same signals by an automaton that looks for all patterns at once."""
    names = X.arrivals(s, d).select("document_id", "file_name")
    rows = X.table(s, d, "documents").select(F.col("doc_id").alias("document_id"), scoring.matched_signals(F.col("text"), RULES).alias("texts"))
    found = scoring.joined_signals(F.col("texts"), scoring.name_signals(F.col("file_name"), RULES), RULES)
    return rows.join(names, "document_id").select("document_id", F.explode_outer(found).alias("x")).select("document_id", "x.category", "x.keywords", "x.sentences", "x.filenames", "x.raw", "x.score")


@query
def rule_signals_many(s, d):
    """Signals of a rule set of thousands of patterns: every word and every three words in a row of the benchmark's items."""
    rules = scoring.Rules.of(X.item_rules(s, d))
    rows = X.table(s, d, "documents").select("doc_id", F.explode_outer(scoring.text_signals(F.col("text"), rules)).alias("x"))
    return rows.select("doc_id", "x.category", "x.keywords", "x.sentences")


@query
def rule_scores(s, d):
    """The score of every category, as a row's JSON column holds them."""
    return _found(s, d).select("document_id", scoring.all_scores(F.col("found")).alias("all_scores"))


@query
def rule_winner(s, d):
    return _found(s, d).select("document_id", scoring.winner(F.col("found")).alias("w")).select("document_id", F.col("w.category").alias("category"), F.col("w.score").alias("score"), scoring.status_of(F.col("w.score")).alias("status"))


def _with_ai(s, d):
    best = _found(s, d).select("document_id", "empty", scoring.winner(F.col("found")).alias("w")).select("document_id", "empty", F.col("w.category").alias("rule_category"), F.col("w.score").alias("rule_score"))
    return best.join(X.ai_results(s, d), "document_id", "left")


@query
def score_combine(s, d):
    c = F.col
    return _with_ai(s, d).filter("ai_category IS NOT NULL").select("document_id", scoring.combine(c("rule_score"), c("rule_category"), c("ai_score"), c("ai_category")).alias("x")).select("document_id", "x.*")


def _routed(s, d):
    c = F.col
    return _with_ai(s, d).select("document_id", "rule_category", "rule_score", scoring.route(c("rule_score"), c("rule_category"), c("ai_score"), c("ai_category"), c("ai_reasoning"), c("empty")).alias("x")).select("document_id", "rule_category", "rule_score", "x.*")


@query
def classify_route(s, d):
    return _routed(s, d)


@query
def classification_rows(s, d):
    """Rows to append to the classification table: where each waiting document goes, and the scores of all categories."""
    c = F.col
    found = _found(s, d).select("document_id", "empty", scoring.winner(c("found")).alias("w"), scoring.all_scores(c("found")).alias("all_scores"))
    rows = found.join(R.queue(*_tables(s, d)).select("document_id"), "document_id", "left_semi").join(X.ai_results(s, d), "document_id", "left")
    routed = scoring.route(c("w.score"), c("w.category"), c("ai_score"), c("ai_category"), c("ai_reasoning"), c("empty"))
    rows = rows.select("document_id", c("w.score").alias("rule_confidence_score"), "all_scores", routed.alias("x"))
    return rows.select("document_id", "rule_confidence_score", "all_scores", c("x.final_category").alias("document_type"), "x.classification_status", "x.classification_tier", "x.combined_confidence_score")


@query
def class_batch_rollup(s, d):
    waiting = R.queue(*_tables(s, d)).select("document_id")
    return R.batch_rollup(_routed(s, d).join(waiting, "document_id", "left_semi"))


@query
def ai_validate(s, d):
    """Models' answers as JSON, some broken, some out of range, some with categories of their own."""
    i = F.col("doc_id")
    category = F.when(i % 5 == 0, "Sports").when(i % 5 == 1, "Invoices").when(i % 5 == 2, "Miscellaneous").otherwise("Contracts")
    answer = F.when(i % 9 == 0, "not json").otherwise(F.concat(F.lit('{"predicted_category": "'), category, F.lit('", "confidence_score": '), ((i * 7) % 160 - 20).cast("string"), F.lit("}")))
    said = F.from_json(answer, "predicted_category string, confidence_score double")
    rows = X.table(s, d, "documents").select("doc_id", said.alias("said")).filter("said.predicted_category IS NOT NULL")
    return rows.select("doc_id", scoring.validated(F.col("said.predicted_category"), F.col("said.confidence_score")).alias("x")).select("doc_id", "x.category", "x.score")


@query
def clean_native(s, d):
    """Cleaning over texts with broken lines, runs of blanks and typographic marks put in."""
    dirty = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "e ", "e  \t"), "\\. ", ".\u0001\n\n\n\n\n \n"), "tion", "ti-\n on’…")
    return X.table(s, d, "documents").select("doc_id", F.md5(text.clean_native(dirty).cast("binary")).alias("cleaned_md5"), F.length(text.clean_native(dirty)).cast("long").alias("n_cleaned"))


@query
def clean_text_full(s, d):
    return X.table(s, d, "documents").select("doc_id", text.clean_text(F.col("text"), "reference").alias("cleaned"))


@query
def clean_text_safe(s, d):
    return X.table(s, d, "documents").select("doc_id", text.clean_text(F.col("text"), "safe").alias("cleaned"))


@query
def chunks_char_window(s, d):
    rows = X.table(s, d, "documents").select("doc_id", F.posexplode(chunking.char_windows(F.coalesce("text", F.lit("")))).alias("chunk_index", "chunk"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query
def chunks_structured(s, d):
    rows = X.table(s, d, "documents").select("doc_id", chunking.chunks(chunking.sections(F.col("text"))).alias("c"))
    return rows.select("doc_id", F.posexplode("c").alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.text", "c.chunk_type")


@query
def page_layout_text(s, d):
    """Text of printed pages from their blocks."""
    return L.plain_text(X.page_blocks(s, d)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query
def page_layout_sections(s, d):
    """Paragraphs and tables of printed pages from their blocks and boxes."""
    rows = L.sections(X.page_blocks(s, d), X.page_tables(s, d))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_type", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def table_sentences(s, d):
    """Line items of each order as a table of words."""
    rows = X.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_returnflag"), F.col("l_quantity").cast("int").cast("string"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string")).alias("row"))
    tables = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "row"))).alias("rows"))
    head = F.array(F.array(F.lit("Mode:"), F.lit("Quantity"), F.lit("Price")))
    cells = F.concat(head, F.transform("rows", lambda x: x["row"]))
    return tables.select("l_orderkey", chunking.table_sentences(cells).alias("sentences"))


@query
def full_document_text(s, d):
    """The turns of each conversation as one text."""
    rows = X.table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return rows.select("conv_id", F.md5(chunking.full_text(F.transform("t", lambda x: x["text"])).cast("binary")).alias("text_md5"))


@query
def search_console(s, d):
    """Search results as a console shows them."""
    rows = semantic_search(s, d)
    return rows.select("rank", text.score_bar(F.col("similarity_score")).alias("bar"), text.shortened(F.col("excerpt"), 100).alias("excerpt"))


@query
def stream_daily_counts(s, d):
    from ..streaming.streams import daily_counts

    return daily_counts(s, d)


@query
def stream_notifications(s, d):
    from ..streaming.streams import notifications

    return notifications(s, d)


@query
def stream_notifications_pending(s, d):
    """Notifications of a stream that weren't sent before, through a table that takes each once."""
    from ..streaming.streams import told

    docs, cls = _tables(s, d)
    return told(X.sent_notifications(notifications_events(s, d)), cls, docs, X.ownership(s, d))


def _slices(rows: DataFrame, at: Column, n: int = 4) -> list[DataFrame]:
    """Rows in n steps of equal spans of time; without rows, steps without rows."""
    ends = rows.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    if ends.low is None:
        return [rows] * n
    cuts = [ends.low + (ends.high - ends.low) * k / n for k in range(1, n)]
    step = sum((F.when(at.cast("timestamp_ntz") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    return [rows.filter(step == k) for k in range(n)]


@query
def stream_notifications_live(s, d):
    """Notifications of streams of classifications, files and owners; files come a step late, owners a step later."""
    from ..streaming.streams import told_live

    docs, cls = _tables(s, d)
    owners = X.ownership(s, d).join(docs.select("document_id", "current_timestamp_ist"), "document_id")
    steps = [_slices(x, F.col("current_timestamp_ist")) for x in (cls, docs, owners)]
    late = [[x.filter(F.lit(False))] * k + parts + [x.filter(F.lit(False))] * (2 - k) for k, (x, parts) in enumerate(zip((cls, docs, owners), steps, strict=True))]
    return told_live(*late, lateness="2 hours")


def _cells(s, d):
    """Files that come in two parts, and what their statuses change to: of one part even before the files themselves."""
    from ..streaming.dashboards import changes
    from ..streaming.streams import counted

    old, new = X.arrivals(s, d), X.documents(s, d)
    first = F.col("document_id") % 2 == 0
    return counted([changes(None, old.filter(first)), changes(old.filter(~first), new.filter(~first)), changes(None, old.filter(~first)), changes(old.filter(first), new.filter(first))])


@query
def stream_files_summary(s, d):
    """The totals of all files from signed counts of changes alone."""
    from ..streaming import dashboards

    return dashboards.files_summary(_cells(s, d))


@query
def stream_stats_by_source(s, d):
    from ..streaming import dashboards

    return dashboards.stats_by_source(_cells(s, d))


@query
def stream_stats_by_day(s, d):
    from ..streaming import dashboards

    return dashboards.stats_by_day(_cells(s, d), X.AS_OF)


@query
def stream_dedup_corrected(s, d):
    """Duplicates by name of files that come in any order, and of which some are deleted later: as the rescan has them."""
    from ..streaming.streams import ingest_corrected

    rows = X.arrivals(s, d).select("document_id", "file_name", "file_path", "processing_status", F.col("current_timestamp_ist").alias("ts"))
    alive = rows.withColumns({"processing_status": F.when(F.col("processing_status") == "Deleted", "In Progress").otherwise(F.col("processing_status")), "seq": F.lit(0)})
    younger, gone = F.col("document_id") % 3 != 1, rows.filter("processing_status = 'Deleted'").withColumn("seq", F.lit(1))
    return ingest_corrected([alive.filter(younger), gone.filter("document_id % 2 = 0"), alive.filter(~younger), gone.filter("document_id % 2 = 1")])


@query
def stream_ingest_duplicates(s, d):
    from ..streaming.streams import ingest_duplicates

    return ingest_duplicates(s, d)


def _vector_index(s, d) -> tuple[VectorIndex, DataFrame]:
    """An index of all vectors, and as queries those whose id is divisible by 100."""
    rows = X.embeddings(s, d).select("embedding_id", "embedding")
    return VectorIndex.build(rows, "embedding_id", "embedding", place(s, "vector-index")), rows.filter("embedding_id % 100 = 0")


def _nearest(index: VectorIndex, queries: DataFrame, **options) -> DataFrame:
    return index.search(queries, "embedding_id", "embedding", V.CANDIDATES, **options).select("query", "rank", "embedding_id", F.round("similarity", 4).alias("similarity"))


@query
def vector_topk_index(s, d):
    """The top 20 of several vectors through an index, with every cell that could hold one of them."""
    index, queries = _vector_index(s, d)
    return _nearest(index, queries, exact=True)


@query
def vector_topk_probed(s, d):
    """The same in the cells nearest to each vector alone, as many as find 19 of 20 by the index's own measure."""
    index, queries = _vector_index(s, d)
    return _nearest(index, queries, probes=index.probes_for(0.95))


@query
def vector_topk_arrow(s, d):
    """The same top 20 with whole Arrow batches in numpy."""
    vector = [float(x) for x in X.query_vector(s, d).first()[0]]
    rows = X.embeddings(s, d).withColumn("similarity", vectors.cosine_to(vector, F.col("embedding")))
    return V.top(rows).select("embedding_id", "document_id", "chunk_index", F.round("similarity", 4).alias("similarity"))
