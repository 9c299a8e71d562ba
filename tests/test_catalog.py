"""The stage catalogue, and the pipelines from model files to a submission."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ballot.plans import files
from ballot.session import scratch_path
from ballot.sources.catalog import Stage, StageCatalog

WEIGHTS = [("a1", 300_000, 1, "backbone"), ("a2", 200_000, 2, "backbone"), ("b", 250_000, 3, "backbone"), ("c", 100_000, 4, "aux")]


def write_model(spark, path, shift=0):
    df = spark.range(1, 9).select(F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("r"))
    df = df.select("user_id", ((F.col("user_id") + F.col("r") + shift) % 7 + 100).alias("book_id"), (-F.col("r")).cast("double").alias("raw_score"))
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def given(spark):
    users = spark.range(1, 9).select(F.col("id").alias("user_id"), F.lit("g").alias("grp"))
    truth = spark.range(1, 5).select(F.col("id").alias("user_id"), ((F.col("id") + 1) % 7 + 100).alias("book_id"))
    train = spark.sql("SELECT 1L user_id, 100L book_id, TIMESTAMP_NTZ'2020-01-01 00:00:00' ts, 0L seq")
    books = spark.range(100, 107).select(F.col("id").alias("book_id"))
    return (Stage("val", "v1", truth), Stage("users", "u1", users), Stage("train", "t1", train)), books


def run(spark, base, models, out):
    catalog = StageCatalog(spark, base)
    holdout, books = given(spark)
    sources = [(m, "a" if m[0] == "a" else m, f"{models}/{m}") for m, *_ in WEIGHTS]
    picks = files.run_files(catalog, sources, "a", WEIGHTS, holdout, books, out, aux=["c"], cap=50_000)
    return catalog, rows(picks, "user_id", "book_id", "score", "source")


def test_a_second_run_writes_nothing_and_a_changed_file_its_branch(spark):
    base, models, out = (scratch_path(spark, x) for x in ("t-catalog", "t-models", "t-out"))
    for i, (m, *_) in enumerate(WEIGHTS):
        write_model(spark, f"{models}/{m}", i % 2)
    first, picks = run(spark, base, models, out)
    assert len(picks) == 8 and set(first.written) == {*(f"list-{m}" for m, *_ in WEIGHTS), "family-a", "top10", "voters", "picks"}
    second, again = run(spark, base, models, out)
    assert second.written == [] and again == picks

    write_model(spark, f"{models}/b", 3)
    third, changed = run(spark, base, models, out)
    assert set(third.written) == {"list-b", "top10", "voters", "picks"} and changed != picks
    assert sorted(third.clean()) == ["list-b", "picks", "top10", "voters"]
    fourth, same = run(spark, base, models, out)
    assert fourth.written == [] and same == changed and fourth.clean() == ["voters"]  # read only to build the picks


def test_final_vote_from_earlier_stages_alone(spark):
    base, models, out = (scratch_path(spark, x) for x in ("t-catalog", "t-models", "t-out"))
    for m, *_ in WEIGHTS:
        write_model(spark, f"{models}/{m}")
    _, picks = run(spark, base, models, out)
    catalog = StageCatalog(spark, base)
    (validation, users, train), books = given(spark)
    lists = [(m, catalog.latest(f"list-{m}")) for m in "bc"]
    voters = [catalog.latest("family-a"), *(files.named_list(m, s) for m, s in lists)]
    alone = files.final_vote_from_stages(catalog, voters, catalog.latest("top10"), validation, users, train, books, out, aux=["c"], cap=50_000)
    assert rows(alone, "user_id", "book_id", "score", "source") == picks and catalog.written == []


def test_a_stage_cut_off_is_written_again(spark):
    catalog = StageCatalog(spark, scratch_path(spark, "t-catalog"))

    def fails():
        return spark.range(3).select(F.raise_error(F.lit("lost")).alias("x"))

    with pytest.raises(Exception, match="lost"):
        catalog.stage("s", fails, params={"p": 1})
    again = StageCatalog(spark, catalog.base)
    assert again.stage("s", lambda: spark.range(3), params={"p": 1}).frame.count() == 3 and again.written == ["s"]
    assert again.stage("s", lambda: spark.range(4), params={"p": 2}).frame.count() == 4  # another parameter, another stage
    with pytest.raises(ValueError, match="no stage"):
        again.latest("other")
