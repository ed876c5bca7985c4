import os

import duckdb
import pytest

import __spark_entry__
from quernstone.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = """candidate_rows eligible_rows dataset_fingerprint rank_ties score_bm25 retrieval_vector_metrics normalise_tokens mask_tokens check_seq_gaps check_twin_links
event_seq_assign import_runs_renumber judge_inputs compare_verdict placement_slots index_percentiles early_stopping stream_append_seq assign_splits assign_splits_by_domain
batch_schedule pair_batches drawn_pairs effect_difference changed_buffers settled_values three_layers r0_unjudged missing_imports foreign_pointer_windows stack_origin
fill_origin garbage_bytes info_nce queue_excluded migrate_steps text_bm25_benchmark record_measurements boundary_values float_bits gaps""".split()
#: QUERNSTONE_ALL_QUERIES=1 compares every query that has SQL.
CHOSEN = sorted(catalogue.oracles()) if os.environ.get("QUERNSTONE_ALL_QUERIES") else QUICK


def shown(x):
    return repr(tuple(round(v, 6) if isinstance(v, float) else v for v in x))


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = db.execute(catalogue.oracles()[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(shown, found.fetchall()))
    frame = catalogue.queries()[name](spark, sf_dir)
    assert sorted(frame.columns) == sorted(columns)
    assert sorted(shown(r) for r in frame.select(*columns).collect()) == want


def test_sign_extended_keeps_large_supplier_keys_whole(spark, tmp_path):
    db = duckdb.connect()
    db.execute(f"COPY (SELECT i::BIGINT AS l_orderkey, 1::INT AS l_linenumber, (i * 1009)::BIGINT AS l_partkey, (i * 9973)::BIGINT AS l_suppkey FROM range(20) AS r(i)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    found = db.execute(catalogue.oracles()["sign_extended"])
    columns = [c[0] for c in found.description]
    got = catalogue.queries()["sign_extended"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())


def test_narrow_task_reads_lines_once(spark, sf_dir, monkeypatch):
    from quernstone.plans import retrieval_queries

    plans, stored = [], retrieval_queries.stored
    monkeypatch.setattr(retrieval_queries, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name))
    queries, pool = retrieval_queries.narrow_task(spark, sf_dir, *retrieval_queries.retrieval.STRUCTURE)
    assert sum(p.count("/lineitem.parquet") for p in plans) == 1
    assert queries.count() and pool.count()


@pytest.mark.parametrize("name", ["metrics_macro", "metrics_per_package", "package_table"])
def test_reports_by_package_do_not_make_gold_pairs(spark, sf_dir, monkeypatch, name):
    from quernstone.operators import retrieval

    monkeypatch.setattr(retrieval, "evaluate", None)
    test_query_equals_its_sql(spark, sf_dir, name)


def test_entry(spark, sf_dir):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.oracles()) == set(catalogue.queries()) and len(catalogue.queries()) > 180


def test_nothing_outside_imports_the_training_operators():
    from pathlib import Path

    top = Path(catalogue.__file__).parents[1]
    outside = [p for p in top.rglob("*.py") if "llm" not in p.parts]
    assert outside and not any("quernstone.llm" in p.read_text() for p in outside)


def counts_matches(spark, sf_dir, monkeypatch, name):
    """The query equals its SQL without a matrix of all pairs and without gold pairs."""
    from quernstone.operators import blocks, retrieval

    monkeypatch.setattr(retrieval, "evaluate", None)
    monkeypatch.setattr(blocks, "shared_weights", None)
    test_query_equals_its_sql(spark, sf_dir, name)


def test_macro_means_come_of_matches(spark, sf_dir, monkeypatch):
    counts_matches(spark, sf_dir, monkeypatch, "metrics_macro")


def test_package_table_comes_of_matches(spark, sf_dir, monkeypatch):
    counts_matches(spark, sf_dir, monkeypatch, "package_table")


def test_metrics_of_packages_come_of_matches(spark, sf_dir, monkeypatch):
    counts_matches(spark, sf_dir, monkeypatch, "metrics_per_package")


def test_bm25_metrics_come_of_matches_of_contents(spark, sf_dir, monkeypatch):
    counts_matches(spark, sf_dir, monkeypatch, "retrieval_bm25_metrics")


def test_vector_metrics_do_not_make_gold_pairs(spark, sf_dir, monkeypatch):
    from quernstone.operators import retrieval

    monkeypatch.setattr(retrieval, "rank_vector", None)
    test_query_equals_its_sql(spark, sf_dir, "retrieval_vector_metrics")
    test_query_equals_its_sql(spark, sf_dir, "score_vector")


def test_jaccard_metrics_come_of_counts(spark, sf_dir, monkeypatch):
    counts_matches(spark, sf_dir, monkeypatch, "retrieval_jaccard_metrics")


def scores_answers_once(spark, sf_dir, monkeypatch, name):
    """The query equals its SQL, and the answers that are read twice are scored once."""
    from quernstone.operators import blocks

    plans, ranks = [], blocks.ranks_by_blocks
    monkeypatch.setattr(blocks, "ranks_by_blocks", lambda left, right, answers, *a, **b: plans.append(answers._jdf.queryExecution().executedPlan().toString()) or ranks(left, right, answers, *a, **b))
    test_query_equals_its_sql(spark, sf_dir, name)
    assert len(plans) == 1 and "MapInArrow" not in plans[0]


def test_package_table_scores_answers_once(spark, sf_dir, monkeypatch):
    scores_answers_once(spark, sf_dir, monkeypatch, "package_table")


def test_metrics_of_packages_score_answers_once(spark, sf_dir, monkeypatch):
    scores_answers_once(spark, sf_dir, monkeypatch, "metrics_per_package")
