"""Pipelines P1-P4: the three ensemble scripts and the full run, as lazy plans.

Stage files (O04) are optional checkpoints: when a path is given the stage is
written as parquet and read back, which also cuts the lineage so a lost
executor recomputes from the stage file, not from the raw inputs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballot.operators.candidates import (
    coborrow_candidates,
    cold_start_sources,
    embedding_variant,
    graph_propagate,
    history_candidates,
    popularity_candidates,
    popularity_for_users,
)
from ballot.operators.evaluate import hit_at_k, submission_check, temporal_holdout, train_before
from ballot.operators.layer1 import integrate_family, topk_fusion
from ballot.operators.layer2 import cascade, top1_by_consensus, union_models, weighted_vote
from ballot.operators.prepare import conform, standardize
from ballot.operators.weights import cap_weights, model_weights
from ballot.schema import BOOK, FAMILY, MODEL, PREDICTIONS, RAW, RNK, USER
from ballot.session import scratch_path
from ballot.sources.io import read_stage, read_submission, write_stage, write_submission


def stage(df: DataFrame, path: str | None) -> DataFrame:
    """Write a predictions frame to ``path`` and return it read back."""
    if not path:
        return df
    write_stage(df.select(*PREDICTIONS.fieldNames()), path)
    return read_stage(df.sparkSession, path, PREDICTIONS)


_stage = stage


def layer1_family(
    preds: DataFrame,
    weights: DataFrame,
    family: str = "v5",
    variants: Sequence[str] | None = None,
    k: int = 10,
    min_support: int = 7,
    stage_path: str | None = None,
    truth: DataFrame | None = None,
    list_bound: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """P1: integrate a family's variants into one list (one more model): O06,
    with ``truth`` (validation users) O07, then O19."""
    out = integrate_family(
        preds, family, weights, variants=variants, k=k, min_support=min_support, truth=truth, list_bound=list_bound, rows=rows
    )
    return _stage(out.select(*PREDICTIONS.fieldNames()), stage_path)


def layer1_top10(
    preds: DataFrame, weights: DataFrame, k: int = 10, stage_path: str | None = None, validate: bool | str = True,
    rows: int | None = None,
) -> DataFrame:
    """P2: weighted fusion of the given models to a Top-10 baseline list."""
    out = topk_fusion(preds, weights, k=k, name=f"top{k}", validate=validate, rows=rows).select(*PREDICTIONS.fieldNames())
    return _stage(out, stage_path)


@dataclass
class FinalVote:
    picks: DataFrame
    weights: DataFrame
    votes: DataFrame


def standardized(preds: DataFrame, list_bound: int | None = None) -> DataFrame:
    """The lists with their scores standardised (O06, by rank): one scale for
    all models, the order inside each list unchanged."""
    return standardize(preds, "rank", out="_std", list_bound=list_bound).withColumn(RAW, F.col("_std")).select(*PREDICTIONS.fieldNames())


def checked(picks: DataFrame, users: DataFrame, books: DataFrame) -> None:
    """Raise ``ValueError`` unless the picks pass the submission check (O30)."""
    chk = submission_check(picks, users, books).collect()[0]
    if any(chk[c] for c in ("missing", "duplicate_users", "null_keys", "unknown_books", "unknown_users")):
        raise ValueError(f"submission check failed: {chk.asDict()}")


def final_vote(
    voters: DataFrame,
    truth_val: DataFrame,
    users: DataFrame,
    train: DataFrame,
    aux: Sequence[str] = (),
    cap: int | None = None,
    total_cap: int | None = None,
    m: int = 2,
    top10: DataFrame | None = None,
    books: DataFrame | None = None,
    out_path: str | None = None,
    stage_path: str | None = None,
    standardize_voters: bool = True,
    list_bound: int | None = None,
) -> FinalVote:
    """P3: standardised voters, weights from validation, capped aux weights,
    flat Top-1 vote, arbitration and the cascade consensus -> vote -> Top-10 ->
    cold start; with ``out_path`` the checked submission (O30, then O03).

    ``voters`` are Layer-2 models (families already merged by P1).  With
    ``stage_path`` the voters and the picks are written once each and read
    back: the weights, the vote, the check and the submission read stages
    instead of recomputing the voters' lineage.  ``picks`` are then those of
    the submission, read back.  Voters already standardised are told by
    ``standardize_voters``.  ``list_bound`` as in O06.
    """
    spark = voters.sparkSession
    voters = standardized(voters, list_bound) if standardize_voters else voters
    voters = _stage(voters, f"{stage_path}/voters" if stage_path else None)
    w = model_weights(voters, truth_val, k=1, aux=aux)
    if cap is not None:
        w = cap_weights(w, cap, total_cap)
    votes = weighted_vote(voters, w, k=1, validate=False)
    sources: list = [(None, top1_by_consensus(votes, m))]
    if top10 is not None:
        sources.append(
            ("top10", top10.filter(F.col(RNK) == 1).select(USER, BOOK, F.col(RAW).cast("long").alias("score")))
        )
    sources += cold_start_sources(users, train)
    picks = cascade(sources)
    if stage_path:
        write_stage(picks, f"{stage_path}/picks")
        picks = spark.read.parquet(f"{stage_path}/picks")
    if out_path:
        if books is not None:
            checked(picks, users, books)
        write_submission(picks, out_path)
        picks = read_submission(spark, out_path).join(picks, [USER, BOOK])
    return FinalVote(picks=picks, weights=w, votes=votes)


def stage_holdout(interactions: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """Truth and train written to ``base`` and read back.  The truth is written
    first, and train is built from that stage, so the last-borrow window runs once."""
    spark = interactions.sparkSession
    truth, _ = temporal_holdout(interactions)
    write_stage(truth, f"{base}/truth")
    truth = spark.read.parquet(f"{base}/truth")
    write_stage(train_before(interactions, truth), f"{base}/train")
    return truth, spark.read.parquet(f"{base}/train")


#: Layer-2 names of the generated lists (the emb variants are merged into one).
GENERATED = ("popular", "history", "coborrow", "graph", "emb")


def candidate_lists(train: DataFrame, items: DataFrame, users: DataFrame, k: int = 10) -> list[DataFrame]:
    """Sub-model jobs on the training borrows, each a predictions frame."""
    pop = popularity_for_users(popularity_candidates(train, k, users), users)
    lists = [
        ("popular", pop),
        ("history", history_candidates(train, k)),
        ("coborrow", coborrow_candidates(train, k)),
        ("graph", graph_propagate(train, k)),
    ]
    lists += [("emb", embedding_variant(items, train, d, k)) for d in (16, 32, 64)]
    # a list has one family, so it is not shuffled with the rows
    return [conform(x.drop(FAMILY), list_bound=k).withColumn(FAMILY, F.lit(family)) for family, x in lists]


def full_run(
    planted: DataFrame,
    interactions: DataFrame,
    items: DataFrame,
    users: DataFrame,
    layer1_weights: DataFrame,
    aux: Sequence[str] = (),
    cap: int | None = None,
    k: int = 10,
    work_dir: str | None = None,
    total_cap: int | None = None,
    books: DataFrame | None = None,
    holdout: tuple[DataFrame, DataFrame] | None = None,
    list_bound: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """P4: candidate jobs -> P1 per family -> P2 -> P3 -> O24 on test users.

    ``planted`` are external model lists (already conformed); generated lists
    are added as more voters.  They are new models, so they enter as aux ones:
    each weight is capped by ``cap``, all aux weights together by ``total_cap``.  Every layer is written to ``work_dir`` (default:
    a fresh folder under ``spark.checkpoint.dir``) and read back, so each layer
    is computed once and a lost executor recomputes from the last stage only.
    The picks are checked against ``users`` and ``books`` (O30), written as the
    submission (O03) to ``work_dir``/submission and read back.  Output: hit@1 on the test users for every Layer-2 voter and for the final
    picks (model = 'final').  ``holdout``: the stages of ``stage_holdout``, if written.
    ``list_bound``: a proven bound on the rows of a planted list, ``rows``: about how many
    planted rows there are; lists are then dealt by user once, to partitions numbered by them.
    """
    spark = planted.sparkSession
    base = work_dir or scratch_path(spark, "full-run")
    truth, train = holdout or stage_holdout(interactions, base)
    val = truth.filter(F.col("split") == "validation").select(USER, BOOK)
    test = truth.filter(F.col("split") == "test").select(USER, BOOK)

    # a stage a list, so that the shuffle files of one are gone before the next
    lists = [planted] + candidate_lists(train, items, users, k)
    allp = union_models([_stage(x, f"{base}/lists/{i}") for i, x in enumerate(lists)])
    bound = list_bound and max(list_bound, k)
    fam_v5 = layer1_family(allp, layer1_weights, "v5", min_support=7, stage_path=f"{base}/family_v5", truth=val, list_bound=bound, rows=rows)
    emb = allp.filter(F.col("family") == "emb")
    emb_weights = model_weights(emb, val, k=k)
    fam_emb = layer1_family(emb, emb_weights, "emb", min_support=2, stage_path=f"{base}/family_emb", truth=val, list_bound=bound)
    others = allp.filter(~F.col("family").isin("v5", "emb"))
    voters = _stage(union_models([fam_v5, fam_emb, others]), f"{base}/voters")
    top10 = layer1_top10(allp, model_weights(allp, val, k=k), k, stage_path=f"{base}/top10", validate=False, rows=rows)
    if bound is not None:  # a merged list holds at most the books of its variants
        bound *= layer1_weights.count() + len(lists)
    fv = final_vote(
        voters, val, users, train, aux=[*aux, *GENERATED], cap=cap, total_cap=total_cap, top10=top10,
        books=books, out_path=f"{base}/submission", stage_path=f"{base}/final", list_bound=bound,
    )
    picks = fv.picks
    per_voter = hit_at_k(voters, test, 1)
    final = hit_at_k(picks, test, 1, name="final")
    return per_voter.unionByName(final).select(MODEL, "n_users", "hits", "rate")
