"""Spark queries against their DuckDB oracle at sf0.001 (whole tables)."""

import duckdb
import pytest
from conftest import SF_SMALL

import __spark_entry__ as entry

TABLES = "customer part orders lineitem embeddings".split()
NAMES = [
    "o05_conform",
    "o06_standardize",
    "o07_calibrate",
    "o08_model_weights",
    "o08_bootstrap_weights",
    "o10_support_filter",
    "o13_supplementary",
    "o15_variant_intersection",
    "o17_weighted_vote",
    "o22_top1",
    "o23_decision_margin",
    "o26_variant_stability",
    "o27_admission_scenarios",
    "o30_submission_check",
    "o31_graph_propagate",
    "o31_graph_layers",
    "o32_embedding_variant",
    "o33_text_embedding",
    "o36_coborrow_candidates",
    "o37_hybrid_candidates",
    "o38_cold_start_fill",
    "o39_assemble_features",
    "o40_gbdt_facts",
    "o41_search_facts",
    "p1_layer1_family",
    "p2_layer1_top10",
    "p3_final_vote",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _canon(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(r[i]) if not hasattr(r[i], "isoformat") else r[i].isoformat() for i in order) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    exp = rel.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(exp)
    assert _canon(df.columns, got) == _canon(cols, exp)


def test_every_query_has_oracle_or_is_declared_rows_only():
    rows_only = {"o40_gbdt_scorer", "o41_model_search"}
    llm = set(entry.LLM_QUERIES)
    q, o = set(entry.queries()) - llm, set(entry.oracle_sql()) - llm
    assert o <= q
    assert q - o == rows_only


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "book_id", "score", "source"]
    assert df.count() == 150
