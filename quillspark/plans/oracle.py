"""The queries as DuckDB SQL over the driver's tables; the derived tables of `fixtures.py` are common table expressions."""

from __future__ import annotations

from ..functions import text
from . import fixtures as X

_KIND = " ".join(f"WHEN '{i:x}' THEN '{k}'" for i, k in enumerate(X.KINDS))
_SOURCE = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(X.SOURCES))
_case = lambda of, values: f"CASE {of} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"

ARRIVED = f"""
arrived AS (
  SELECT *, concat('/src/', coalesce(source_type, 'unknown'), '/', substr(md5(CAST(document_id AS VARCHAR)), 1, 12), '/', file_name) AS file_path FROM (
    SELECT doc_id AS document_id, concat(CASE substr(md5(coalesce(text, '')), 1, 1) {_KIND} ELSE 'report' END, '_', substr(md5(coalesce(text, '')), 1, 12), '.pdf') AS file_name,
      CASE doc_id % 6 {_SOURCE} END AS source_type, n_chars AS file_size, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 61) AS current_timestamp_ist,
      CASE WHEN doc_id % 17 = 0 THEN 'Deleted' WHEN doc_id % 13 = 0 THEN 'Ingested' ELSE 'In Progress' END AS processing_status, CAST(NULL AS TIMESTAMP) AS processed_at
    FROM documents))"""
META = f"""{ARRIVED},
ranked AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY file_name, processing_status = 'Deleted') AS n, first(file_path) OVER w AS first_path
  FROM arrived WINDOW w AS (PARTITION BY file_name, processing_status = 'Deleted' ORDER BY current_timestamp_ist, document_id)),
meta AS (
  SELECT document_id, file_name, file_path, source_type, file_size, current_timestamp_ist, processed_at,
    CASE WHEN processing_status = 'Deleted' THEN 'Deleted' WHEN k = 1 THEN 'Original' ELSE 'Duplicate' END AS processing_status,
    processing_status <> 'Deleted' AND k > 1 AS is_duplicate, CASE WHEN processing_status <> 'Deleted' AND k > 1 THEN first_path END AS duplicate_of
  FROM ranked)"""
CLASS = f"""{META},
cls AS (
  SELECT document_id * 10 + k AS classification_id, document_id, {_case("(document_id + k) % 6", X.STATUSES)} AS classification_status, {_case("(document_id + 2 * k) % 6", X.TYPES)} AS document_type,
    CAST((document_id * 37 + k) % 101 AS DOUBLE) AS combined_confidence_score, CAST((document_id * 37 + k) % 101 AS DOUBLE) AS confidence_score,
    CASE WHEN document_id % 3 = 0 THEN 'rule_only' ELSE 'rule_and_ai' END AS classification_tier, current_timestamp_ist + to_days(CAST(k AS INTEGER)) AS current_timestamp_ist
  FROM meta, (VALUES (0), (1)) AS v(k) WHERE NOT is_duplicate AND processing_status <> 'Deleted' AND document_id % 5 <> 0 AND (k = 0 OR document_id % 11 = 0)),
newest AS (SELECT * FROM cls QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY current_timestamp_ist DESC, classification_id DESC) = 1)"""
_EMB = """
emb AS (
  SELECT vec_id AS embedding_id, vec_id % 100 AS document_id, CAST(vec_id // 100 AS INTEGER) AS chunk_index, CASE WHEN vec_id % 29 <> 0 THEN embedding END AS embedding,
    CASE WHEN vec_id % 29 = 0 THEN 'failed' ELSE 'generated' END AS embedding_status, substr(text, 1 + 200 * (vec_id // 100), 200) AS chunk_text
  FROM embeddings JOIN documents ON doc_id = vec_id % 100),
qv AS (SELECT embedding AS query FROM embeddings WHERE vec_id = 0)"""
EMB = f"{CLASS},{_EMB}"
_EXCERPT = "substr(replace(trim(chunk_text, ' '), chr(10), ' '), 1, 500)"


def _search(chunks: str) -> str:
    return f"""{EMB},
hits AS (SELECT *, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(query AS DOUBLE[])) AS similarity FROM ({chunks}) c, qv ORDER BY similarity DESC, embedding_id LIMIT 20),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY similarity DESC, embedding_id, classification_id) = 1),
found AS (SELECT CAST(row_number() OVER (ORDER BY similarity DESC, embedding_id) AS INTEGER) AS rank, document_id, file_name, source_type, document_type, classification_status, chunk_index, round(similarity, 4) AS similarity_score, {_EXCERPT} AS excerpt FROM best ORDER BY similarity DESC, embedding_id LIMIT 5)"""


_ELIGIBLE = "SELECT e.*, m.file_name, m.source_type, c.document_type, c.classification_status, c.classification_id FROM emb e JOIN meta m USING (document_id) JOIN cls c USING (document_id) WHERE e.embedding IS NOT NULL AND embedding_status = 'generated' AND c.classification_status IN ('auto_classified', 'human_approved')"
_STAGE2 = "SELECT e.*, m.file_name, m.source_type, CAST(NULL AS VARCHAR) AS document_type, m.processing_status AS classification_status, 0 AS classification_id FROM emb e JOIN meta m USING (document_id) WHERE e.embedding IS NOT NULL AND embedding_status = 'generated' AND m.source_type = 'Outlook'"
_SIM = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(query AS DOUBLE[]))"
_FILE = "document_id, file_name, file_path, processing_status, is_duplicate, duplicate_of, source_type, file_size, current_timestamp_ist"
_LIVE = "processing_status <> 'Deleted'"
_BRIEF = "c.classification_id, c.document_id, m.file_name, m.source_type, c.document_type, c.classification_status, c.classification_tier, c.combined_confidence_score"
_OPEN = "c.classification_status IN ('soft_flag', 'hard_stop')"
_GROUPS = f"SELECT file_name, count(*) AS copy_count, min(current_timestamp_ist) AS earliest, max(current_timestamp_ist) AS latest, string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS srcs FROM meta WHERE {_LIVE} GROUP BY file_name HAVING count(*) FILTER (WHERE is_duplicate) > 0"
_OWN = f"{CLASS}, own AS (SELECT document_id, CASE WHEN document_id % 4 <> 0 THEN concat('u', document_id % 5) END AS user_id FROM arrived WHERE source_type = 'manual_upload')"
_EVENTS = f"""{_OWN},
ev AS (SELECT DISTINCT ON (user_id, classification_id, notification_type) user_id, notification_type, title, message, document_id, classification_id FROM (
  SELECT o.user_id, c.document_id, c.classification_id,
    CASE WHEN {_OPEN} THEN 'document_in_review' WHEN s = 'auto_classified' THEN 'document_classified' WHEN s = 'human_approved' THEN 'document_approved' WHEN s = 'human_rejected' THEN 'document_rejected' END AS notification_type,
    CASE WHEN {_OPEN} THEN 'Your document is under review' WHEN s = 'auto_classified' THEN 'Document classified' WHEN s = 'human_approved' THEN 'Document approved' WHEN s = 'human_rejected' THEN 'Document sent to Miscellaneous' END AS title,
    CASE WHEN {_OPEN} THEN concat('"', file_name, '" has been flagged for human review (confidence ', p, '%). An admin will review it shortly.')
         WHEN s = 'auto_classified' THEN concat('"', file_name, '" was automatically classified as ', document_type, ' (', p, '% confidence).')
         WHEN s = 'human_approved' THEN concat('"', file_name, '" was reviewed and approved as ', document_type, ' by an admin.')
         WHEN s = 'human_rejected' THEN concat('"', file_name, '" was reviewed and could not be classified into a specific category. It has been moved to Miscellaneous.') END AS message
  FROM (SELECT *, classification_status AS s, CAST(CAST(combined_confidence_score AS BIGINT) AS VARCHAR) AS p FROM cls) c JOIN (SELECT document_id, file_name FROM meta WHERE source_type = 'manual_upload') m USING (document_id) JOIN own o USING (document_id) WHERE o.user_id IS NOT NULL) WHERE notification_type IS NOT NULL)"""


def _rules() -> str:
    """Keywords by Unicode word boundaries, which RE2 has to spell out."""
    edge = r"[^\p{L}\p{N}\p{M}_]"
    word = lambda w: f"CAST(regexp_matches(low, '(^|{edge}){w}($|{edge})') AS INTEGER)"
    rows = []
    for i, (c, kinds) in enumerate(X.CORPUS_RULES.items()):
        k = " + ".join(map(word, kinds["keywords"]))
        s = " + ".join(f"CAST(contains(low, '{x}') AS INTEGER)" for x in kinds["sentences"])
        f = " + ".join(f"CAST(regexp_matches(name, '{p}') AS INTEGER)" for p in kinds["filename_patterns"])
        rows.append(f"SELECT document_id, empty, '{c}' AS category, {i} AS ord, {k} AS keywords, {s} AS sentences, {f} AS filenames FROM texts")
    return f"""{CLASS},
texts AS (SELECT doc_id AS document_id, coalesce(text, '') = '' AS empty, lower(coalesce(text, '')) AS low, regexp_replace(lower(file_name), '[_-]', ' ', 'g') AS name FROM documents JOIN arrived ON document_id = doc_id),
sig AS (SELECT *, 2 * keywords + 5 * sentences + 10 * filenames AS raw, round(least((2 * keywords + 5 * sentences + 10 * filenames) / {X.CORPUS_BASELINE} * 100, 100.0), 2) AS score FROM ({" UNION ALL ".join(rows)})),
win AS (SELECT document_id, empty, category AS rule_category, CAST(score AS DOUBLE) AS rule_score FROM sig QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY score DESC, keywords + sentences + filenames DESC, filenames DESC, sentences DESC, keywords DESC, ord) = 1),
ai AS (SELECT doc_id AS document_id, CASE substr(md5(CAST(doc_id AS VARCHAR)), 3, 1) {" ".join(f"WHEN '{i:x}' THEN '{t}'" for i, t in enumerate(X.TYPES))} ELSE 'Contracts' END AS ai_category, CAST((doc_id * 37) % 101 AS DOUBLE) AS ai_score FROM documents WHERE doc_id % 23 <> 0),
both_ AS (SELECT * FROM win LEFT JOIN ai USING (document_id)),
comb AS (SELECT document_id, rule_category = ai_category AS categories_agreed, round(least(CASE WHEN rule_category = ai_category THEN rule_score * 0.35 + ai_score * 0.65 ELSE greatest(rule_score, ai_score) * 0.75 END, 100.0), 2) AS combined_score,
  CASE WHEN rule_category = ai_category OR ai_score >= rule_score THEN ai_category ELSE rule_category END AS final_category FROM both_ WHERE ai_category IS NOT NULL),
comb2 AS (SELECT *, CASE WHEN combined_score >= 70 THEN 'auto_classified' WHEN combined_score >= 40 THEN 'soft_flag' ELSE 'hard_stop' END AS status FROM comb),
cased AS (SELECT b.*, c.combined_score, c.final_category, c.status, rule_score > 0 AND rule_score < 70 AS asks,
  CASE WHEN rule_score = 0 THEN 'zero' WHEN rule_score >= 70 THEN 'rule' WHEN ai_category IS NULL THEN 'failed' WHEN ai_category = 'Miscellaneous' THEN 'misc' ELSE 'both' END AS kase FROM both_ b LEFT JOIN comb2 c USING (document_id)),
routed0 AS (SELECT *, CASE WHEN kase IN ('zero', 'misc') THEN 'auto_miscellaneous' WHEN kase = 'rule' THEN 'auto_classified' WHEN kase = 'failed' THEN CASE WHEN rule_score >= 40 THEN 'soft_flag' ELSE 'hard_stop' END ELSE status END AS classification_status FROM cased),
routed AS (SELECT document_id, rule_category, rule_score, CASE WHEN asks THEN 'rule_and_ai' ELSE 'rule_only' END AS classification_tier, classification_status,
  CASE WHEN kase IN ('zero', 'misc') THEN 'Miscellaneous' WHEN kase = 'both' THEN final_category ELSE rule_category END AS final_category,
  CASE WHEN kase = 'misc' THEN ai_score WHEN kase = 'both' THEN combined_score ELSE rule_score END AS combined_confidence_score,
  CASE WHEN kase = 'zero' THEN 'auto_miscellaneous' WHEN kase = 'rule' THEN 'rule_based' WHEN kase = 'failed' THEN 'rule_based + human_in_the_loop' WHEN kase = 'misc' OR classification_status = 'auto_classified' THEN 'rule_based + ai' ELSE 'rule_based + ai + human_in_the_loop' END AS type_of_classification,
  CASE WHEN kase = 'zero' THEN 'Auto-routed to Miscellaneous: zero confidence score. Document text was readable but contained no keywords, sentences, or filename patterns matching any of the 5 active categories (Contracts, Compliance, Governance, Certifications, Invoices). Document likely belongs to a category outside the active set.'
       WHEN kase = 'misc' THEN concat('Auto-routed to Miscellaneous: AI classifier determined document does not belong to any of the 5 active categories. AI confidence: ', CAST(CAST(ai_score AS BIGINT) AS VARCHAR), '.0%. AI reasoning: by its text') END AS classification_notes,
  CASE WHEN asks THEN ai_category END AS ai_predicted_category, CASE WHEN asks AND ai_category IS NOT NULL THEN ai_score END AS ai_confidence_score FROM routed0)"""


_state = lambda c, *names: ", ".join(f"count(*) FILTER (WHERE {c} = '{n}') AS {a}" for n, a in names)
_CLEAN = r"""
d0 AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'e ', concat('e  ', chr(9)), 'g'), '\. ', concat('.', chr(1), repeat(chr(10), 5), ' ', chr(10)), 'g'), 'tion', concat('ti-', chr(10), ' on’…'), 'g') AS t FROM documents),
d1 AS (SELECT doc_id, regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS t FROM d0),
d2 AS (SELECT doc_id, regexp_replace(t, '([\p{L}\p{M}\p{N}_])-\s*\n\s*([\p{L}\p{M}\p{N}_])', '\1\2', 'g') AS t FROM d1),
d3 AS (SELECT doc_id, regexp_replace(t, '[ \t]+', ' ', 'g') AS t FROM d2),
d4 AS (SELECT doc_id, regexp_replace(regexp_replace(t, ' *\n *', chr(10), 'g'), '\n{4,}', repeat(chr(10), 3), 'g') AS t FROM d3),
d5 AS (SELECT doc_id, trim(replace(translate(t, '‘’“”—–', '''''""--'), '…', '...'), concat(' ', chr(10), chr(9), chr(13))) AS t FROM d4)"""

ORACLE_SQL: dict[str, str] = {
    "semantic_search": f"WITH {_search(_ELIGIBLE)} SELECT * FROM found",
    "semantic_search_filtered": f"WITH {_search(_ELIGIBLE + " AND c.document_type = 'Contracts'")} SELECT * FROM found",
    "semantic_search_fallback": f"WITH {_search(_STAGE2)} SELECT * FROM found",
    "qa_context": f"WITH {_search(_ELIGIBLE)} SELECT string_agg(concat('[Source: ', file_name, ' | Category: ', document_type, ']', chr(10), trim(excerpt, ' ')), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank) AS context FROM found WHERE rank <= 3",
    "search_console": f"WITH {_search(_ELIGIBLE)} SELECT rank, repeat('█', CAST(floor(similarity_score * 20) AS INTEGER)) AS bar, CASE WHEN length(trim(excerpt, ' ')) > 100 THEN concat(left(trim(excerpt, ' '), 100), '...') ELSE trim(excerpt, ' ') END AS excerpt FROM found",
    "vector_topk": f"WITH {EMB} SELECT embedding_id, document_id, chunk_index, round({_SIM}, 4) AS similarity FROM emb, qv WHERE embedding IS NOT NULL ORDER BY {_SIM} DESC, embedding_id LIMIT 20",
    "vector_threshold": f"WITH {EMB} SELECT embedding_id, document_id, round({_SIM}, 4) AS similarity FROM emb, qv WHERE embedding IS NOT NULL AND {_SIM} >= 0.2",
    "embedding_inventory": f"WITH {EMB} SELECT document_id, file_name, source_type, count(chunk_index) AS chunks FROM emb JOIN meta USING (document_id) WHERE embedding IS NOT NULL GROUP BY ALL",
    "embedding_state": f"WITH {EMB} SELECT file_name, e.document_id, c.document_id AS class_document_id, classification_status, document_type, count(chunk_index) AS chunk_count FROM emb e JOIN meta m ON m.document_id = e.document_id LEFT JOIN cls c ON c.document_id = e.document_id WHERE embedding_status = 'generated' GROUP BY ALL",
    "embedding_upsert": f"""WITH {EMB},
        new AS (SELECT document_id, chunk_index + 1 AS chunk_index, concat('new ', chunk_text) AS chunk_text, 'generated' AS embedding_status FROM emb WHERE document_id < 50),
        up AS (SELECT * FROM new UNION ALL SELECT document_id, chunk_index, chunk_text, embedding_status FROM emb ANTI JOIN new USING (document_id, chunk_index))
        SELECT document_id, chunk_index, chunk_text, CASE WHEN chunk_index = 0 AND document_id % 7 = 0 THEN 'skipped_miscellaneous' ELSE embedding_status END AS embedding_status FROM up""",
    "files_list": f"WITH {META} SELECT {_FILE} FROM meta WHERE {_LIVE} AND NOT is_duplicate AND source_type = 'Outlook'",
    "files_duplicates_list": f"WITH {META} SELECT {_FILE} FROM meta WHERE {_LIVE} AND is_duplicate ORDER BY current_timestamp_ist DESC, document_id LIMIT 100 OFFSET 5",
    "files_all_latest_class": f"WITH {CLASS} SELECT m.{_FILE.replace(', ', ', m.')}, c.classification_id, c.document_type, c.confidence_score, c.classification_status, c.classification_tier FROM meta m LEFT JOIN newest c USING (document_id) WHERE {_LIVE}",
    "files_summary": f"WITH {META} SELECT count(*) AS total, {_state('processing_status', ('Original', 'originals'), ('Duplicate', 'duplicates'), ('Deleted', 'deleted'), ('Ingested', 'ingested'))}, count(*) FILTER (WHERE processing_status NOT IN ('Original', 'Duplicate', 'Deleted', 'Ingested')) AS other, {_state('source_type', ('Outlook', 'from_outlook'), ('Sharepoint', 'from_sharepoint'), ('manual_upload', 'from_manual'))} FROM meta",
    "document_by_id": f"WITH {META} SELECT {_FILE} FROM meta WHERE document_id = 34",
    "document_to_classify": f"WITH {META} SELECT document_id, file_name, source_type, CAST(current_timestamp_ist AS VARCHAR) AS ingested_at FROM meta WHERE document_id = 42 AND NOT is_duplicate",
    "files_deleted_answer": f"""WITH {META}, gone AS (SELECT document_id, row_number() OVER (ORDER BY processed_at DESC NULLS LAST, current_timestamp_ist DESC, document_id) AS k FROM meta WHERE processing_status = 'Deleted')
        SELECT count(*) AS total, 7 AS "limit", 2 AS "offset", count(*) FILTER (WHERE k > 9) > 0 AS has_more, coalesce(string_agg(CAST(document_id AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k BETWEEN 3 AND 9), '') AS items FROM gone""",
    "duplicate_groups_page": f"WITH {META} SELECT file_name, copy_count, strftime(earliest, '%Y-%m-%dT%H:%M:%S') AS earliest, strftime(latest, '%Y-%m-%dT%H:%M:%S') AS latest, coalesce(srcs, '') AS sources FROM ({_GROUPS}) ORDER BY copy_count DESC, file_name LIMIT 10 OFFSET 3",
    "services_health": "WITH s AS (SELECT event_type, coalesce(min(value) > 0, false) AS well FROM events GROUP BY event_type) SELECT CASE WHEN coalesce(bool_and(well), true) THEN 'healthy' ELSE 'degraded' END AS overall, count(*) AS services, count(*) FILTER (WHERE NOT well) AS degraded FROM s",
    "users_seeded": "SELECT 'empty' AS table_name, min(concat('u', user_id % 60)) AS user_id FROM events WHERE user_id % 60 < 50",
    "rule_scores": f"WITH {_rules()} SELECT document_id, concat('{{', string_agg(concat('\"', category, '\":', CAST(CAST(score AS DOUBLE) AS VARCHAR)), ',' ORDER BY ord), '}}') AS all_scores FROM sig GROUP BY document_id",
    "classification_rows": f"""WITH {_rules()}, sc AS (SELECT document_id, concat('{{', string_agg(concat('\"', category, '\":', CAST(CAST(score AS DOUBLE) AS VARCHAR)), ',' ORDER BY ord), '}}') AS all_scores FROM sig GROUP BY document_id)
        SELECT document_id, rule_score AS rule_confidence_score, all_scores, final_category AS document_type, classification_status, classification_tier, combined_confidence_score FROM routed JOIN sc USING (document_id) SEMI JOIN (SELECT document_id FROM meta ANTI JOIN cls USING (document_id) WHERE {_LIVE} AND NOT is_duplicate) q USING (document_id)""",
    "files_duplicates_by_name": f"WITH {META}, g AS ({_GROUPS}) SELECT {_FILE} FROM meta WHERE {_LIVE} AND is_duplicate AND file_name = (SELECT min(file_name) FROM g)",
    "files_deleted": f"WITH {META} SELECT {_FILE}, processed_at FROM meta WHERE processing_status = 'Deleted' AND file_name ILIKE '%INVOICE%'",
    "duplicate_groups": f"WITH {META} SELECT file_name, copy_count, earliest, latest, coalesce(srcs, '') AS sources FROM ({_GROUPS})",
    "duplicate_group_copies": f"WITH {META}, g AS (SELECT file_name FROM meta WHERE {_LIVE} AND source_type = 'Outlook' GROUP BY file_name HAVING count(*) FILTER (WHERE is_duplicate) > 0) SELECT file_name, CAST(row_number() OVER (PARTITION BY file_name ORDER BY is_duplicate, current_timestamp_ist, document_id) AS INTEGER) AS copy_no, document_id, file_path, is_duplicate, duplicate_of, source_type FROM meta SEMI JOIN g USING (file_name) WHERE {_LIVE}",
    "duplicate_group_count": f"WITH {META} SELECT count(*) AS total FROM ({_GROUPS})",
    "dedup_rescan": f"WITH {META} SELECT document_id, file_name, processing_status, is_duplicate, duplicate_of FROM meta",
    "dedup_rescan_counts": f"WITH {META}, g AS (SELECT file_name, count(*) AS n FROM arrived WHERE {_LIVE} GROUP BY file_name) SELECT count(*) FILTER (WHERE n > 1) AS duplicate_groups_found, CAST(sum(n - 1) AS BIGINT) AS records_marked_duplicate, count(*) AS records_marked_original FROM g",
    "ingest_dup_check": f"WITH {META}, p AS (SELECT a.document_id, (SELECT b.file_path FROM arrived b WHERE b.file_name = a.file_name AND b.processing_status <> 'Deleted' AND (b.current_timestamp_ist, b.document_id) < (a.current_timestamp_ist, a.document_id) ORDER BY b.current_timestamp_ist, b.document_id LIMIT 1) AS duplicate_of, a.file_name FROM arrived a) SELECT document_id, file_name, duplicate_of IS NOT NULL AS is_duplicate, duplicate_of FROM p",
    "ingest_insert_missing": f"WITH {META} SELECT document_id, file_path FROM arrived WHERE source_type IS DISTINCT FROM 'Outlook'",
    "soft_delete": f"WITH {META} SELECT CASE WHEN document_id IN (1, 2, 3, 5, 8) THEN 'Deleted' ELSE processing_status END AS processing_status, count(*) AS n FROM meta GROUP BY 1",
    "sources": f"WITH {META} SELECT source_type, count(*) AS total, {_state('processing_status', ('Original', 'originals'), ('Duplicate', 'duplicates'))} FROM meta WHERE {_LIVE} AND source_type IS NOT NULL GROUP BY source_type",
    "stats_totals": f"WITH {META} SELECT count(*) AS total, {_state('processing_status', ('Original', 'originals'), ('Duplicate', 'duplicates'))} FROM meta WHERE {_LIVE}",
    "stats_by_source": f"WITH {META} SELECT source_type, {_state('processing_status', ('Original', 'original'), ('Duplicate', 'duplicate'))} FROM meta WHERE {_LIVE} AND source_type IS NOT NULL GROUP BY source_type",
    "stats_by_day": f"WITH {META} SELECT CAST(current_timestamp_ist + INTERVAL '330 minutes' AS DATE) AS date, count(*) AS count FROM meta WHERE current_timestamp_ist >= TIMESTAMP '{X.AS_OF}' - INTERVAL '30 days' GROUP BY 1",
    "metadata_search": f"WITH {CLASS} SELECT m.{_FILE.replace(', ', ', m.')}, c.document_type, c.confidence_score, c.classification_status FROM meta m LEFT JOIN newest c USING (document_id) WHERE {_LIVE} AND (file_name ILIKE '%contract%' OR file_path ILIKE '%contract%') AND c.document_type = 'Contracts'",
    "class_queue": f"WITH {CLASS} SELECT document_id, file_name, file_path, source_type, current_timestamp_ist FROM meta ANTI JOIN cls USING (document_id) WHERE {_LIVE} AND NOT is_duplicate",
    "class_queue_count": f"WITH {CLASS} SELECT count(*) AS queue_count FROM meta ANTI JOIN cls USING (document_id) WHERE {_LIVE} AND NOT is_duplicate",
    "pending_review": f"""WITH {CLASS}, r AS (SELECT *, CAST(CAST(c.combined_confidence_score AS BIGINT) AS VARCHAR) || '.0' AS p FROM cls c JOIN (SELECT document_id, source_type, file_name FROM meta) m USING (document_id) WHERE {_OPEN})
        SELECT classification_id, document_id, source_type, file_name, document_type AS suggested_category, combined_confidence_score AS confidence_score, classification_status, CASE WHEN classification_status = 'hard_stop' THEN 'mandatory' ELSE 'recommended' END AS review_urgency,
          CASE WHEN classification_status = 'hard_stop' THEN concat('Confidence ', p, '% is below 40%. Use override_category to manually assign the correct category. Valid categories: Contracts, Compliance, Governance, Certifications, Invoices, Miscellaneous.') ELSE concat('Confidence ', p, '% (between 40-70%). System suggests ''', document_type, '''. Confirm with human_decision=true or supply override_category.') END AS review_guidance FROM r""",
    "unfinalized": f"WITH {CLASS} SELECT {_BRIEF} FROM cls c JOIN meta m USING (document_id) WHERE c.classification_status = 'soft_flag'",
    "unfinalized_page_counts": f"WITH {CLASS} SELECT count(*) AS on_page, {_state('classification_status', ('soft_flag', 'soft_flag'), ('hard_stop', 'hard_stop'))} FROM (SELECT * FROM cls c WHERE {_OPEN} ORDER BY current_timestamp_ist DESC, classification_id LIMIT 100)",
    "class_results": f"WITH {CLASS} SELECT {_BRIEF} FROM cls c JOIN meta m USING (document_id) WHERE classification_tier = 'rule_and_ai' AND source_type = 'Sharepoint'",
    "class_summary": f"WITH {CLASS} SELECT count(*) AS total_classified, {_state('classification_status', *[(s, s) for s in X.STATUSES])}, {_state('classification_tier', ('rule_only', 'rule_only'), ('rule_and_ai', 'ai_assisted'))}, {_state('document_type', *[(t, t.lower()) for t in X.TYPES])} FROM cls",
    "review_apply": f"""WITH {CLASS}, r AS (SELECT c.*, m.file_path, classification_id % 4 <> 0 AS yes, concat('r', classification_id % 3) AS reviewed_by, CASE WHEN classification_id % 3 = 0 THEN 'Invoices' ELSE document_type END AS wanted FROM cls c JOIN meta m USING (document_id) WHERE {_OPEN})
        SELECT classification_id, document_id, CASE WHEN yes THEN wanted ELSE 'Miscellaneous' END AS document_type,
          concat('DIC/', CASE WHEN yes THEN wanted ELSE 'Miscellaneous' END, '/src/', split_part(file_path, '/', 3), '/', split_part(file_path, '/', 5)) AS output_document_path,
          CASE WHEN yes THEN 'human_approved' ELSE 'human_rejected' END AS classification_status, yes AS human_decision, reviewed_by,
          CASE WHEN NOT yes THEN concat('Rejected by reviewer ''', reviewed_by, '''. System had suggested ''', document_type, '''. Routed to Miscellaneous by reviewer decision.') END AS classification_notes FROM r""",
    "visible_documents_user": f"WITH {_OWN} SELECT document_id, source_type FROM meta m WHERE {_LIVE} AND (source_type IN ('Outlook', 'Sharepoint', 'rdbms', 'rdbms_flow') OR source_type = 'manual_upload' AND EXISTS (SELECT 1 FROM own o WHERE o.document_id = m.document_id AND o.user_id = 'u1'))",
    "visible_documents_admin": f"WITH {META} SELECT document_id, source_type FROM meta WHERE {_LIVE}",
    "user_documents": f"WITH {_OWN} SELECT m.document_id, m.file_name, m.source_type, m.processing_status, m.current_timestamp_ist, c.document_type, c.classification_status, c.combined_confidence_score AS confidence_score FROM meta m LEFT JOIN newest c USING (document_id) WHERE {_LIVE} AND file_name ILIKE '%report%' AND c.classification_status = 'auto_classified' AND (source_type IN ('Outlook', 'Sharepoint', 'rdbms', 'rdbms_flow') OR source_type = 'manual_upload' AND EXISTS (SELECT 1 FROM own o WHERE o.document_id = m.document_id AND o.user_id = 'u2'))",
    "audit_log": "SELECT event_id AS log_id, concat('u', user_id % 60) AS user_id, event_type AS action, 'document' AS resource_type, props AS details, ts AS created_at, CASE WHEN user_id % 60 < 50 THEN concat('user', user_id % 60, '@example.org') END AS email, CASE WHEN user_id % 60 < 50 THEN concat('User ', user_id % 60) END AS full_name FROM events WHERE event_type = 'purchase'",
    "notifications_events": f"WITH {_EVENTS} SELECT * FROM ev",
    "notifications_pending": f"WITH {_EVENTS} SELECT * FROM ev WHERE classification_id % 3 <> 0",
    "unread_counts": f"WITH {_EVENTS} SELECT user_id, count(*) AS unread FROM ev WHERE classification_id % 2 <> 0 AND user_id <> 'u3' GROUP BY user_id",
    "path_keys": f"WITH {META} SELECT document_id, concat(coalesce(source_type, 'unknown'), '/', split_part(file_path, '/', 4), '/', file_name) AS source_key, concat('DIC/Contracts/', coalesce(source_type, 'unknown'), '/', split_part(file_path, '/', 4), '/', file_name) AS output_key, split_part(file_path, '/', 4) AS guid_folder, '.pdf' AS suffix, left(file_name, length(file_name) - 4) AS stem FROM meta",
    "rule_signals": f"WITH {_rules()} SELECT document_id, category, keywords, sentences, filenames, raw, CAST(score AS DOUBLE) AS score FROM sig",
    "rule_winner": f"WITH {_rules()} SELECT document_id, rule_category AS category, rule_score AS score, CASE WHEN rule_score >= 70 THEN 'auto_classified' WHEN rule_score >= 40 THEN 'soft_flag' ELSE 'hard_stop' END AS status FROM win",
    "score_combine": f"WITH {_rules()} SELECT document_id, combined_score, final_category, status, categories_agreed FROM comb2",
    "classify_route": f"WITH {_rules()} SELECT * FROM routed",
    "class_batch_rollup": f"WITH {_rules()} SELECT count(*) AS total_processed, {_state('classification_status', *[(s, s) for s in ('auto_classified', 'auto_miscellaneous', 'soft_flag', 'hard_stop')])}, {_state('classification_tier', ('rule_only', 'rule_only'), ('rule_and_ai', 'ai_assisted'))} FROM routed SEMI JOIN (SELECT document_id FROM meta ANTI JOIN cls USING (document_id) WHERE {_LIVE} AND NOT is_duplicate) q USING (document_id)",
    "ai_validate": "SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'Invoices' WHEN 2 THEN 'Miscellaneous' ELSE 'Contracts' END AS category, CAST(CASE WHEN doc_id % 5 = 0 THEN least(100, greatest(0, (doc_id * 7) % 160 - 40)) ELSE least(100, greatest(0, (doc_id * 7) % 160 - 20)) END AS DOUBLE) AS score FROM documents WHERE doc_id % 9 <> 0",
    "clean_native": f"WITH {_CLEAN} SELECT doc_id, md5(t) AS cleaned_md5, CAST(length(t) AS BIGINT) AS n_cleaned FROM d5",
    "chunks_char_window": "SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, md5(substr(coalesce(text, ''), 1 + 650 * i, 800)) AS chunk_md5 FROM (SELECT doc_id, text, unnest(generate_series(0, CASE WHEN length(coalesce(text, '')) <= 800 THEN 0 ELSE CAST(ceil((length(text) - 800) / 650) AS BIGINT) END)) AS i FROM documents)",
    "table_sentences": "SELECT l_orderkey, string_agg(concat('Mode: ', l_returnflag, ', Quantity: ', CAST(l_quantity AS INTEGER), ', Price: ', CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) AS VARCHAR), '.'), ' ' ORDER BY l_linenumber, l_returnflag, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) AS VARCHAR)) AS sentences FROM lineitem GROUP BY l_orderkey",
    "full_document_text": "SELECT conv_id, md5(substr(string_agg(text, chr(10) || chr(10) ORDER BY turn, text), 1, 25000)) AS text_md5 FROM conversations GROUP BY conv_id",
}
ORACLE_SQL["vector_topk_index"] = f"""WITH {EMB}, qs AS (SELECT embedding_id AS query, embedding AS q FROM emb WHERE embedding_id % 100 = 0),
near AS (SELECT query, embedding_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 12) AS sim FROM emb, qs WHERE embedding IS NOT NULL AND q IS NOT NULL)
SELECT query, CAST(row_number() OVER w AS INTEGER) AS rank, embedding_id, round(sim, 4) AS similarity FROM near WINDOW w AS (PARTITION BY query ORDER BY sim DESC, embedding_id) QUALIFY row_number() OVER w <= 20"""
ORACLE_SQL["rule_signals_automaton"] = ORACLE_SQL["rule_signals"]
ORACLE_SQL["rule_signals_many"] = f"""WITH items AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM benchmark),
rules AS (SELECT DISTINCT 0 AS kind, unnest(w) AS pattern FROM items UNION ALL
  SELECT DISTINCT 1, array_to_string(w[i:i + 2], ' ') FROM (SELECT w, unnest(generate_series(1, len(w) - 2)) AS i FROM items WHERE len(w) > 2)),
texts AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(low, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) AS pattern FROM texts),
hits AS (SELECT doc_id, kind, length(pattern) % 5 AS ord FROM words JOIN rules USING (pattern) WHERE kind = 0 UNION ALL
  SELECT doc_id, kind, length(pattern) % 5 FROM texts, rules WHERE kind = 1 AND contains(low, pattern)),
cats AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(X.CATEGORIES))}) v(ord, category))
SELECT doc_id, category, CAST(count(*) FILTER (kind = 0) AS INTEGER) AS keywords, CAST(count(*) FILTER (kind = 1) AS INTEGER) AS sentences
FROM (SELECT doc_id, ord, category FROM texts, cats) LEFT JOIN hits USING (doc_id, ord) GROUP BY doc_id, category"""
ORACLE_SQL["stream_embedding_upsert"] = ORACLE_SQL["embedding_upsert"]
ORACLE_SQL["stream_notifications_pending"] = ORACLE_SQL["notifications_pending"]
_SPACE = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"
LAYOUT = rf"""
split AS (SELECT page_id, url, unnest(string_split(coalesce(html, ''), '<')) AS line, generate_subscripts(string_split(coalesce(html, ''), '<'), 1) - 1 AS i FROM pages),
lines AS (SELECT page_id AS doc_id, url, line, i // {X.PAGE_LINES} AS page, i % {X.PAGE_LINES} AS k, length(line) AS n FROM split),
blocks AS (
  SELECT doc_id, page, k, 10 + n % 5 * 60 AS x0, 10 + k * {X.LINE} AS y0, 18 + k * {X.LINE} + n % 3 * 4 AS y1,
    regexp_replace(CASE WHEN k = 5 THEN url ELSE regexp_replace(line, '^[^>]*>', '') END, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS text FROM lines),
boxes AS (SELECT doc_id, page, k, 12 + k * {X.LINE} AS y0, 45 + k * {X.LINE} AS y1, concat('Kind: k', substr(md5(line), 1, 6), '.') AS text FROM lines WHERE n % 11 = 0),
said AS (SELECT * FROM blocks WHERE text <> '' AND NOT regexp_matches(text, '{text.PAGE_NUMBER}')),
twice AS (SELECT DISTINCT a.doc_id, a.text FROM said a JOIN said b USING (doc_id, k, text) WHERE a.page = 0 AND b.page = 1),
body AS (SELECT * REPLACE (regexp_replace(text, '{_SPACE}+', ' ', 'g') AS text) FROM said s WHERE y1 > 70 AND y0 < 930 AND NOT EXISTS (FROM twice t WHERE t.doc_id = s.doc_id AND t.text = s.text))"""
ORACLE_SQL["page_layout_text"] = f"""WITH {LAYOUT},
p AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY k) AS text FROM body GROUP BY ALL),
d AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM p GROUP BY ALL)
SELECT doc_id, md5(text) AS text_md5, length(text) AS n_chars FROM d"""
ORACLE_SQL["page_layout_sections"] = f"""WITH {LAYOUT},
free AS (SELECT * FROM body b WHERE NOT EXISTS (FROM boxes t WHERE t.doc_id = b.doc_id AND t.page = b.page AND b.x0 < 400 AND b.x0 + 100 > 250 AND b.y0 < t.y1 AND t.y0 < b.y1)),
gaps AS (SELECT *, coalesce(y0 - lag(y1) OVER w > 8, true) AS first FROM free WINDOW w AS (PARTITION BY doc_id, page ORDER BY k)),
islands AS (SELECT *, count(*) FILTER (WHERE first) OVER (PARTITION BY doc_id, page ORDER BY k) AS no FROM gaps),
paragraphs AS (SELECT doc_id, page, no, string_agg(text, ' ' ORDER BY k) AS text FROM islands GROUP BY ALL),
parts AS (SELECT doc_id, page, 0 AS kind, no, text FROM paragraphs WHERE NOT regexp_matches(text, '{text.PAGE_NUMBER}') UNION ALL SELECT doc_id, page, 1, k, text FROM boxes)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, kind, no) - 1 AS chunk_index, CASE kind WHEN 0 THEN 'text' ELSE 'table' END AS chunk_type, md5(text) AS text_md5 FROM parts"""
ORACLE_SQL["qa_answer"] = f"""SELECT 'What is agreed?' AS question, CASE WHEN trim(context) <> '' THEN concat('See ', array_to_string(regexp_extract_all(context, '\\[Source: ([^|\\]]*) \\|', 1), ', '), '.') END AS answer,
CASE WHEN trim(context) <> '' THEN 'answered' ELSE 'no_sources' END AS answer_status FROM ({ORACLE_SQL['qa_context']})"""
ORACLE_SQL["files_duplicates_list_indexed"] = ORACLE_SQL["files_duplicates_list"]
ORACLE_SQL["files_list_deep"] = f"WITH {META} SELECT {_FILE} FROM meta WHERE {_LIVE} AND NOT is_duplicate ORDER BY current_timestamp_ist DESC, document_id LIMIT 20 OFFSET (SELECT count(*) // 2 FROM meta WHERE {_LIVE} AND NOT is_duplicate)"
ORACLE_SQL["document_by_id_bucketed"] = ORACLE_SQL["document_by_id"]
ORACLE_SQL["files_all_latest_class_bucketed"] = ORACLE_SQL["files_all_latest_class"]
ORACLE_SQL["pending_review_bucketed"] = ORACLE_SQL["pending_review"]
ORACLE_SQL["stream_notifications_live"] = ORACLE_SQL["notifications_events"]
ORACLE_SQL["stream_files_summary"] = ORACLE_SQL["files_summary"]
ORACLE_SQL["stream_stats_by_source"] = ORACLE_SQL["stats_by_source"]
ORACLE_SQL["stream_stats_by_day"] = ORACLE_SQL["stats_by_day"]
ORACLE_SQL["stream_dedup_corrected"] = ORACLE_SQL["dedup_rescan"]
ORACLE_SQL["files_deleted_indexed"] = ORACLE_SQL["files_deleted"]
ORACLE_SQL["metadata_search_indexed"] = ORACLE_SQL["metadata_search"]
ORACLE_SQL["metadata_search_wildcards"] = f"WITH {CLASS} SELECT m.{_FILE.replace(', ', ', m.')}, c.document_type, c.confidence_score, c.classification_status FROM meta m LEFT JOIN newest c USING (document_id) WHERE {_LIVE} AND (file_name ILIKE '%Outl_ok/%_a%.PDF%' OR file_path ILIKE '%Outl_ok/%_a%.PDF%')"
ORACLE_SQL["vector_topk_arrow"] = ORACLE_SQL["vector_topk"]
ORACLE_SQL["stream_notifications"] = ORACLE_SQL["notifications_events"]
ORACLE_SQL["stream_ingest_duplicates"] = ORACLE_SQL["ingest_dup_check"]
ORACLE_SQL["stream_daily_counts"] = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL"
