import pytest

import __spark_entry__ as entry
from quillspark.plans.fixtures import CORPUS_RULES
from quillspark.plans.oracle import ORACLE_SQL
from quillspark.plans.queries import QUERIES
from tests.compare import duck, duck_rows, plain, spark_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        assert spark_rows(df) == duck_rows(con, ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_prune(spark, sf_dir):
    plan = QUERIES["class_summary"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "lang" not in scan and "source" not in scan


#: The order that each listing promises.
ORDERED = {
    "files_list": "current_timestamp_ist DESC, document_id",
    "files_duplicates_list": "current_timestamp_ist DESC, document_id",
    "files_all_latest_class": "current_timestamp_ist DESC, document_id",
    "files_deleted": "processed_at DESC NULLS LAST, current_timestamp_ist DESC, document_id",
    "duplicate_groups_page": "copy_count DESC, file_name",
    "sources": "total DESC, source_type",
    "stats_by_day": "date",
    "metadata_search": "current_timestamp_ist DESC, document_id",
    "class_queue": "current_timestamp_ist, document_id",
    "pending_review": "confidence_score DESC NULLS FIRST, classification_id",
    "semantic_search": "rank",
    "vector_topk": "similarity DESC, embedding_id",
}


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_order(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cols = df.columns
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]}) ORDER BY {ORDERED[name]}").fetchall()
    assert [tuple(map(plain, r)) for r in df.collect()] == [tuple(map(plain, r)) for r in want]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["rule_signals", "rule_scores", "rule_winner", "classify_route", "score_combine", "classification_rows"])
def test_each_pattern_is_looked_for_once(spark, sf_dir, name):
    plan = _plan(QUERIES[name](spark, sf_dir))
    patterns = [p for kinds in CORPUS_RULES.values() for p in (*(f", {x})" for x in kinds["sentences"]), *kinds["filename_patterns"])]
    assert {p: plan.count(p) for p in patterns} == dict.fromkeys(patterns, 1)
    assert plan.count("split(") == 1 and plan.count("RLIKE") == 5


@pytest.mark.parametrize("name", ["dedup_rescan", "ingest_dup_check"])
def test_no_window_over_a_name(spark, sf_dir, name):
    assert "Window" not in _plan(QUERIES[name](spark, sf_dir))


def test_search_is_one_pass(spark, sf_dir):
    plan = QUERIES["semantic_search_fallback"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("embeddings.parquet") == 2  # the vectors, and the query's
