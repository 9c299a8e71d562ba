"""Read-back tests for O01-O04 in fresh scratch folders."""

import pytest
from conftest import rows

from ballot.schema import PREDICTIONS, VOTES
from ballot.session import scratch_path
from ballot.sources import io as IO


def _write_csv(path, text):
    import os

    local = path.removeprefix("file:")
    os.makedirs(local, exist_ok=True)
    with open(f"{local}/part-0.csv", "w") as fh:
        fh.write(text)


def test_read_predictions_by_header_name(spark):
    base = scratch_path(spark, "t-io")
    _write_csv(f"{base}/a", "book_id,user_id,raw_score\n10,1,0.5\n11,1,0.7\n")
    _write_csv(f"{base}/b", "user_id,book_id,rnk\n1,12,1\n")
    df = IO.read_predictions(spark, [("a", "fa", f"{base}/a"), ("b", "fb", f"{base}/b")])
    assert df.columns == PREDICTIONS.fieldNames()
    assert rows(df) == [("a", "fa", 1, 10, 0.5, None), ("a", "fa", 1, 11, 0.7, None), ("b", "fb", 1, 12, None, 1)]


def test_read_predictions_without_order_needs_one_row_per_user(spark):
    base = scratch_path(spark, "t-io")
    _write_csv(f"{base}/ok", "user_id,book_id\n1,10\n2,11\n")
    _write_csv(f"{base}/bad", "user_id,book_id\n1,10\n1,11\n")
    ok = IO.read_predictions(spark, [("ok", "ok", f"{base}/ok")])
    assert rows(ok, "user_id", "rnk") == [(1, 1), (2, 1)]
    with pytest.raises(ValueError):
        IO.read_predictions(spark, [("bad", "bad", f"{base}/bad")])


def test_read_predictions_failfast_on_bad_value(spark):
    base = scratch_path(spark, "t-io")
    _write_csv(f"{base}/x", "user_id,book_id,raw_score\n1,ten,0.5\n")
    with pytest.raises(Exception):
        IO.read_predictions(spark, [("x", "x", f"{base}/x")]).collect()


def test_submission_round_trip_and_refusal(spark):
    path = scratch_path(spark, "t-sub")
    picks = spark.createDataFrame([(1, 10, 5, "vote"), (2, 11, 3, "vote")], "user_id long, book_id long, score long, source string")
    IO.write_submission(picks, path, single_file=True)
    assert rows(IO.read_submission(spark, path)) == [(1, 10), (2, 11)]
    dup = spark.createDataFrame([(1, 10, 5, "v"), (1, 11, 3, "v")], "user_id long, book_id long, score long, source string")
    with pytest.raises(ValueError):
        IO.write_submission(dup, scratch_path(spark, "t-sub"))


def test_stage_round_trip(spark):
    path = scratch_path(spark, "t-stage")
    votes = spark.createDataFrame([(1, 10, 5, 2, 1)], VOTES)
    IO.write_stage(votes, path)
    assert rows(IO.read_stage(spark, path, VOTES)) == [(1, 10, 5, 2, 1)]
