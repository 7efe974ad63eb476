"""Schemas of the tables that the engine works on."""

from pyspark.sql import types as T

_s, _l, _d, _b, _i, _t = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.TimestampNTZType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(c, t, True) for c, t in columns.items()])


DOCUMENT_METADATA = _struct(document_id=_l, file_name=_s, file_path=_s, processing_status=_s, is_duplicate=_b, duplicate_of=_s, source_type=_s, file_size=_l, current_timestamp_ist=_t, processed_at=_t)
CLASSIFICATION_DOCS = _struct(
    classification_id=_l, document_id=_l, rule_confidence_score=_d, ai_predicted_category=_s, ai_confidence_score=_d, ai_reasoning=_s, combined_confidence_score=_d, confidence_score=_d, document_type=_s, suggested_document_type=_s,
    all_scores=_s, output_document_path=_s, type_of_classification=_s, classification_status=_s, classification_tier=_s, classification_notes=_s, human_decision=_b, reviewed_by=_s, reviewed_at=_t, embedding_id=_l, current_timestamp_ist=_t,
)
DOCUMENT_EMBEDDINGS = _struct(embedding_id=_l, document_id=_l, chunk_index=_i, chunk_text=_s, embedding=T.ArrayType(T.FloatType()), embedding_status=_s, model_name=_s, current_timestamp_ist=_t)
OWNERSHIP = _struct(document_id=_l, user_id=_s, api_key_id=_s)
NOTIFICATIONS = _struct(user_id=_s, notification_type=_s, title=_s, message=_s, document_id=_l, classification_id=_l, is_read=_b, created_at=_t)
AUDIT_LOGS = _struct(log_id=_l, user_id=_s, action=_s, resource_type=_s, resource_id=_s, details=_s, created_at=_t)
USERS = _struct(user_id=_s, email=_s, full_name=_s, role=_s, is_active=_b)
CHUNKS = T.ArrayType(_struct(text=_s, heading_context=_s, chunk_type=_s))

#: Domains of the coded columns.
CATEGORIES = ("Contracts", "Compliance", "Governance", "Certifications", "Invoices")
MISCELLANEOUS = "Miscellaneous"
REVIEWABLE = ("soft_flag", "hard_stop")
SEARCHABLE = ("auto_classified", "human_approved")
ORG_SOURCES = ("Outlook", "Sharepoint", "rdbms", "rdbms_flow")
