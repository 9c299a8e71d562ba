"""Steps whose sides grow with the input: their plans and the paths for hot keys."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from ballot import session
from ballot.functions import bounded_broadcast
from ballot.llm import quality
from ballot.operators import candidates as C
from ballot.operators import evaluate as E
from ballot.operators import layer1 as L1
from ballot.operators import layer2 as L2
from ballot.operators import learn as LR
from ballot.operators import prepare as P
from ballot.operators import text as TX
from ballot.operators.weights import weights_frame
from ballot.plans.registry import QUERIES
from ballot.schema import PREDICTIONS
from ballot.session import _FREED
from ballot.sources import tables as TB
from ballot.sources.fixture import planted_predictions
from ballot.sources.io import write_stage


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_supplementary_never_broadcasts_the_backbone(spark):
    new = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (None, 3, 1)], "user_id long, book_id long, rnk int")
    backbone = spark.createDataFrame([(1, 1, 1), (1, 2, 11), (None, 3, 1)], "user_id long, book_id long, rnk int")
    out = E.supplementary(new, backbone, k=10)
    assert "BroadcastHashJoin" not in _plan(out) and "SortMergeJoin" in _plan(out)
    assert {(r["user_id"], r["book_id"]) for r in out.collect()} == {(1, 2), (None, 3)}


def _borrows(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(25), rng.randrange(40), t, rng.randrange(3)) for t in range(400)]
    rows += [(None, 3, 1, 0), (None, 4, 2, 0), (3, None, 2, 0), (4, None, 9, 1), (None, None, 5, 0), (99, 7, 1, 1)]
    return spark.createDataFrame(rows, "user_id long, book_id long, ts long, seq long")


@pytest.mark.parametrize("make", [C.graph_propagate, C.coborrow_candidates])
def test_links_packed_by_borrow_and_joined_for_hot_keys_agree(spark, make):
    train = _borrows(spark)
    want = sorted(map(str, make(train, hot_rows=1).collect()))
    assert want and sorted(map(str, make(train).collect())) == want


def test_coborrow_scored_in_slices_leaves_only_its_lists(spark, monkeypatch):
    base = session.checkpoint_dir(spark).removeprefix("file:")
    left = lambda: {n for n in os.listdir(base) if n.startswith(("ballot-borrows", "ballot-links", "ballot-neighbours"))}
    want, before = sorted(map(str, C.coborrow_candidates(_borrows(spark)).collect())), left()
    monkeypatch.setattr(C, "BORROWS_A_SLICE", 100, raising=False)
    assert sorted(map(str, C.coborrow_candidates(_borrows(spark)).collect())) == want
    assert left() == before


def test_check_of_a_broadcast_side_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    bounded_broadcast(spark.range(10_000).groupBy((F.col("id") % 7).alias("g")).count())
    until = time.time() + 20
    while (left := _shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left


def test_features_count_pairs_users_and_books(spark):
    train = spark.createDataFrame([(u, (u * b) % 7, b) for u in range(9) for b in range(4)], "user_id long, book_id long, seq long")
    train = train.withColumn("ts", F.lit("2020-01-01").cast("timestamp_ntz"))
    cos = train.select("user_id", "book_id").distinct().withColumn("cosine", F.lit(0.5))
    out = LR.assemble_features(train, train, None, cos)
    assert out.count() == train.select("user_id", "book_id").distinct().count()
    assert out.filter("cosine_missing = 0 and pair_count > 0 and book_count > 0 and user_count = 4").count() == out.count()


def test_links_beside_a_borrow_need_no_join(spark):
    assert "Join" not in _plan(C.graph_propagate(_borrows(spark)))
    assert "Join" not in _plan(C.coborrow_pairs(_borrows(spark)))


def test_conform_numbers_its_partitions_by_rows(spark):
    df = spark.createDataFrame([("m", u, u % 7, 1.0) for u in range(50)], "model string, user_id long, book_id long, raw_score double")
    big, small = P.conform(df, list_bound=10, rows=20 * P.ROWS_EACH), P.conform(df, list_bound=10)
    assert "20), REPARTITION_BY_NUM" in _plan(big)
    assert sorted(map(str, big.collect())) == sorted(map(str, small.collect()))


def test_votes_number_their_partitions_by_ballots(spark):
    preds = spark.createDataFrame([(f"m{u % 3}", "f", u // 3, u % 5, 1.0, 1) for u in range(60)], PREDICTIONS)
    w = weights_frame(spark, [(f"m{i}", 100, i, "backbone") for i in range(3)])
    big = L2.weighted_vote(preds, w, validate=False, rows=19 * L2.BALLOTS_EACH + 1)
    assert "20), REPARTITION_BY_NUM" in _plan(big)
    assert sorted(map(str, big.collect())) == sorted(map(str, L2.weighted_vote(preds, w, validate=False).collect()))


def test_borrows_are_dealt_by_their_number(spark, monkeypatch, tmp_path):
    orders = spark.range(40).selectExpr("nullif(id, 7) o_orderkey", "id % 9 o_custkey", "timestamp_ntz '2020-01-01 00:00:00' o_orderdate")
    lines = spark.range(200).selectExpr("nullif(id % 50, 7) l_orderkey", "id % 11 l_partkey", "cast(id % 7 + 1 as int) l_linenumber")
    for name, df in (("orders", orders), ("lineitem", lines)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    want = sorted(map(str, TB.tpch_interactions(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(TB, "LINES_EACH", 10, raising=False)
    out = TB.tpch_interactions(spark, str(tmp_path))
    assert len(want) == 156 and _plan(out).count("20), REPARTITION_BY_NUM") == 2
    assert sorted(map(str, out.collect())) == want


def test_quality_learns_from_every_labelled_document(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda words: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(80))
    rows = [(i, text("abc" if i % 2 else "xyz"), int(i % 2), 0) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    trusted = labels.filter("quality = 1").select("doc_id")
    judged = lambda: sorted(map(str, quality.judge(docs, trusted, labels=labels).select("doc_id", "_quality.*").collect()))
    want = judged()
    assert sum("kept=True" in r for r in want) == 30
    monkeypatch.setattr(quality, "FIT", 1, raising=False)
    monkeypatch.setattr(quality, "LABELS", 1)
    assert judged() == want


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_a_written_stage_leaves_no_shuffle_files(spark, tmp_path):
    before = _shuffle_files(spark)
    write_stage(spark.range(10_000).groupBy((F.col("id") % 7).alias("g")).count(), str(tmp_path / "stage"))
    until = time.time() + 20
    while (left := _shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(_FREED, None) != "true"
    assert spark.read.parquet(str(tmp_path / "stage")).count() == 7


def test_texts_are_dealt_by_their_number(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 90, f"a{i % 7} b{i % 5} c") for i in range(100)] + [(None, "a1 c")], "id long, t string")
    want = sorted(map(str, TX.text_embedding(docs, "t", 16, id_col="id").collect()))
    monkeypatch.setattr(TX, "TEXTS_EACH", 5, raising=False)
    out = TX.text_embedding(docs, "t", 16, id_col="id")
    assert "21), REPARTITION_BY_NUM" in _plan(out)
    assert sorted(map(str, out.collect())) == want


def test_shuffle_partitions_rise_with_the_rows_and_never_fall(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    try:
        session.partitions_by_rows(spark, 7 * session.ROWS_A_PARTITION + 1)
        assert spark.conf.get(key) == "8"
        session.partitions_by_rows(spark, 10)
        assert spark.conf.get(key) == "8"
    finally:
        spark.conf.set(key, before)


def test_lists_read_several_times_are_conformed_once(spark):
    for name in ("o06_standardize", "o07_calibrate"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan, name  # the planted lists are exploded in the stage's job


def test_model_files_follow_the_rows_not_the_shuffle_partitions(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    truth = spark.range(300).selectExpr("nullif(id, 7) user_id", "id % 40 book_id")
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "60")
    try:
        out = planted_predictions(spark, str(tmp_path), truth, parts=3)
        write_stage(out.select("model", "user_id", "book_id", "raw_score"), f"{tmp_path}/models", fmt="csv", partition_by=["model"])
        want = sorted(map(str, planted_predictions(spark, str(tmp_path), truth).collect()))
    finally:
        spark.conf.set(key, before)
    files = [f for _, _, names in os.walk(f"{tmp_path}/models") for f in names if f.endswith(".csv")]
    assert 16 <= len(files) <= 16 + 2
    assert len(want) == 300 * 160 and sorted(map(str, out.collect())) == want


def test_bounded_lists_are_scaled_and_merged_without_a_join_by_list(spark):
    rows = [(f"m{m}", "f", u, ((u or 0) * m + r) % 9, 1.0, r) for m in range(3) for u in (1, 2, 3, 4, None) for r in range(1, 3 + m)]
    df = spark.createDataFrame(rows, PREDICTIONS)
    bounded = P.standardize(df, "rank", list_bound=10)
    assert "Join" not in _plan(bounded)
    assert sorted(map(str, bounded.collect())) == sorted(map(str, P.standardize(df, "rank").select(*bounded.columns).collect()))

    w = weights_frame(spark, [(f"m{i}", 100 + i, i, "backbone") for i in range(3)])
    truth = spark.createDataFrame([(1, 2), (2, 5), (2, 6), (9, 1)], "user_id long, book_id long")
    merged = lambda bound: L1.integrate_family(df, "f", w, k=3, min_support=1, truth=truth, list_bound=bound)
    numbered = L1.integrate_family(df, "f", w, k=3, min_support=1, list_bound=10, rows=20 * L2.BALLOTS_EACH)
    assert "20), REPARTITION_BY_NUM" in _plan(numbered)
    text = _plan(merged(10))
    assert "SortMergeJoin" not in text and text.count("Exchange hashpartitioning") == 1
    want = sorted(map(str, merged(None).collect()))
    assert want and sorted(map(str, merged(10).collect())) == want


def test_conform_without_families_needs_no_sorted_aggregate(spark):
    df = spark.createDataFrame([("m", u % 9, u % 7, float(u)) for u in range(80)], "model string, user_id long, book_id long, raw_score double")
    out = P.conform(df, list_bound=10)
    assert "SortAggregate" not in _plan(out)
    assert sorted(map(str, out.collect())) == sorted(map(str, P.conform(df.withColumn("family", F.col("model")), list_bound=10).collect()))


def test_fallback_books_are_counted_once(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "user_id long, grp string")
    train = spark.sql("SELECT id % 2 + 1 user_id, id % 3 book_id, TIMESTAMP_NTZ'2020-01-01 00:00:00' ts FROM range(7)")
    group, top = (x for _, x in C.cold_start_sources(users, train))
    assert "Aggregate" not in _plan(group)  # the groups' books are read from their file
    assert sorted(map(tuple, top.collect())) == [(1, 0, 3), (2, 0, 3), (3, 0, 3)]
    none = dict(C.cold_start_sources(users, train.limit(0)))["global_top"]
    assert sorted(map(tuple, none.collect())) == [(1, None, None), (2, None, None), (3, None, None)]
