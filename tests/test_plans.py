"""Physical-plan checks for the scale claims in README.md "Design for scale".

Plans are read with AQE off so the static plan is what Catalyst chose.
"""

import pytest
from conftest import SF_SMALL, preds_df
from pyspark.sql import functions as F

from ballot.operators import candidates as C
from ballot.operators import layer2 as L2
from ballot.operators import prepare as P
from ballot.operators import weights as W
from ballot.plans.registry import QUERIES
from ballot.schema import BACKBONE
from ballot.sources import tables as TB


@pytest.fixture()
def static_plans(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", old)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text: str) -> int:
    return sum(1 for line in text.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line)


def _preds(spark):
    rows = [(m, u, b, float(10 - b)) for m in ("a", "b", "c") for u in range(20) for b in range(5)]
    return preds_df(spark, rows)


def _weights(spark):
    return W.weights_frame(spark, [("a", 400_000, 1, BACKBONE), ("b", 300_000, 2, BACKBONE), ("c", 200_000, 3, BACKBONE)])


def test_conform_is_one_exchange(spark, static_plans):
    p = plan(P.conform(_preds(spark), list_bound=5))
    assert shuffles(p) == 1, p


def test_vote_to_top1_is_one_exchange_with_broadcast_weights(spark, static_plans):
    base = P.conform(_preds(spark), list_bound=5)
    votes_plan = plan(L2.top1(L2.weighted_vote(base, _weights(spark), validate="lazy")))
    # conform's exchange + the ballots' exchange by user; aggregate and window reuse it
    assert shuffles(votes_plan) == 2, votes_plan
    assert "BroadcastHashJoin" in votes_plan
    assert "WindowGroupLimit" in votes_plan


def test_topk_filter_becomes_window_group_limit(spark, static_plans):
    ts = F.lit("2020-01-01").cast("timestamp_ntz")
    train = spark.range(100).select(
        (F.col("id") % 7).alias("user_id"), (F.col("id") % 13).alias("book_id"), ts.alias("ts")
    )
    assert "WindowGroupLimit" in plan(C.history_candidates(train, 10))


def test_reader_prunes_columns_and_pushes_date_filter(spark, static_plans):
    p = plan(TB.tpch_interactions(spark, SF_SMALL, since="2000-01-01"))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int>" in p


def test_no_python_udf_in_core_plans(spark, static_plans):
    base = P.conform(_preds(spark), list_bound=5)
    p = plan(L2.top1(L2.weighted_vote(base, _weights(spark), validate="lazy")))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "WholeStageCodegen" in p or "*(" in p


def test_embedding_profile_is_not_exploded_and_masks_are_not_looped(spark):
    assert "Generate" not in plan(QUERIES["o32_embedding_variant"](spark, SF_SMALL))
    assert "NestedLoop" not in plan(QUERIES["o26_variant_stability"](spark, SF_SMALL))
    assert "NestedLoop" not in plan(QUERIES["o30_submission_check"](spark, SF_SMALL))


def test_final_vote_reads_the_staged_voters(spark):
    """The picks come back from the submission: no copy of Layer 1 is left in the plan."""
    text = plan(QUERIES["p3_final_vote"](spark, SF_SMALL))
    assert text.count("FileScan") == 2 and "FileScan csv" in text and "FileScan parquet" in text
    assert "Window" not in text
