"""P1-P3 from model files to a submission file, through a stage catalogue.

Every model's file is a stage of its own (O01, O05), so a changed file reruns
that list and what is built from it: the family of the model (P1), the Top-10
baseline (P2) and the final vote (P3).  A second run on the same files and
parameters writes nothing but the submission's check.  P3 also runs from the
stages of earlier P1 and P2 runs alone (``final_vote_from_stages``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballot.operators.layer2 import union_models
from ballot.operators.prepare import conform
from ballot.operators.weights import weights_frame
from ballot.plans import ensemble
from ballot.schema import BOOK, FAMILY, MODEL, PREDICTIONS, USER
from ballot.sources.catalog import Stage, StageCatalog
from ballot.sources.io import read_predictions, read_submission, write_submission

Source = tuple[str, str, str]  # model, family, path


def named_list(model: str, stage: Stage) -> Stage:
    """A model's stage with the model's name, which its folder holds."""
    return Stage(stage.name, stage.key, stage.frame.withColumn(MODEL, F.lit(model)).select(*PREDICTIONS.fieldNames()))


def read_lists(
    spark: SparkSession, sources: Sequence[Source], fmt: str = "csv", list_bound: int | None = None, rows: int | None = None
) -> DataFrame:
    """O01 and O05 of the given files; ``rows``: about how many rows a model has."""
    given = read_predictions(spark, sources, fmt=fmt).drop(FAMILY)
    lists = conform(given, list_bound=list_bound, rows=rows and rows * len(sources))
    # the family comes from the list of sources, so it is not shuffled with the rows
    family = F.create_map(*(F.lit(x) for m, fam, _ in sources for x in (m, fam)))
    return lists.withColumn(FAMILY, F.element_at(family, F.col(MODEL))).select(*PREDICTIONS.fieldNames())


def model_lists(
    catalog: StageCatalog, sources: Sequence[Source], fmt: str = "csv", list_bound: int | None = None, rows: int | None = None
) -> dict[str, Stage]:
    """O01 and O05: one conformed list a model.  ``rows``: about how many rows a model has."""
    files = catalog.sources({m: path for m, _, path in sources})
    wanted = {m: (f"list-{m}", files[m], {"family": family, "fmt": fmt}) for m, family, _ in sources}

    def read(models: list[str]) -> DataFrame:
        return read_lists(catalog.spark, [s for s in sources if s[0] in models], fmt, list_bound, rows)

    return {m: named_list(m, stage) for m, stage in catalog.parts(MODEL, wanted, read).items()}


def family_from_files(
    catalog: StageCatalog, lists: dict[str, Stage], variants: Sequence[str], family: str, weights: Sequence[tuple],
    truth: Stage | None = None, k: int = 10, min_support: int = 7, list_bound: int | None = None,
    rows: int | None = None,
) -> Stage:
    """P1: O06, O07 (with ``truth``) and O19 over the variants' lists; ``rows`` as in ``model_lists``."""

    def build() -> DataFrame:
        w = weights_frame(catalog.spark, weights)
        val = truth.frame.select(USER, BOOK) if truth else None
        listed, n = union_models([lists[v].frame for v in variants]), rows and rows * len(variants)
        return ensemble.layer1_family(listed, w, family, variants, k, min_support, truth=val, list_bound=list_bound, rows=n)

    inputs = [*(lists[v] for v in variants), *([truth] if truth else [])]
    return catalog.stage(f"family-{family}", build, inputs, {"weights": weights, "k": k, "min_support": min_support, "truth": bool(truth)})


def top10_from_files(catalog: StageCatalog, lists: dict[str, Stage], weights: Sequence[tuple], k: int = 10, rows: int | None = None) -> Stage:
    """P2: O12 and O20 over all lists; ``rows`` as in ``model_lists``."""

    def build() -> DataFrame:
        listed, n = union_models([s.frame for s in lists.values()]), rows and rows * len(lists)
        return ensemble.layer1_top10(listed, weights_frame(catalog.spark, weights), k, validate="lazy", rows=n)

    return catalog.stage(f"top{k}", build, list(lists.values()), {"weights": weights, "k": k})


def final_vote_from_stages(
    catalog: StageCatalog, voters: Sequence[Stage], top10: Stage, validation: Stage, users: Stage, train: Stage,
    books: DataFrame, out_path: str, aux: Sequence[str] = (), cap: int | None = None, total_cap: int | None = None, m: int = 2,
    list_bound: int | None = None,
) -> DataFrame:
    """P3: the vote of the given voters' stages, checked (O30), written to
    ``out_path`` (O03) and read back with score and source."""

    def build() -> DataFrame:
        every = catalog.stage("voters", lambda: ensemble.standardized(union_models([v.frame for v in voters]), list_bound), voters)
        val = validation.frame.select(USER, BOOK)
        return ensemble.final_vote(every.frame, val, users.frame, train.frame, aux, cap, total_cap, m, top10.frame, standardize_voters=False).picks

    params = {"aux": list(aux), "cap": cap, "total_cap": total_cap, "m": m}
    picks = catalog.stage("picks", build, [*voters, top10, validation, users, train], params)
    ensemble.checked(picks.frame, users.frame, books)
    write_submission(picks.frame, out_path)
    return read_submission(catalog.spark, out_path).join(picks.frame, [USER, BOOK])


def run_files(
    catalog: StageCatalog, sources: Sequence[Source], family: str, weights: Sequence[tuple], holdout: tuple[Stage, Stage, Stage],
    books: DataFrame, out_path: str, aux: Sequence[str] = (), cap: int | None = None, total_cap: int | None = None,
    list_bound: int | None = None, rows: int | None = None,
) -> DataFrame:
    """P1, P2 and P3 from the model files.  ``holdout``: the validation truth,
    the users and the training borrows, as stages.  ``rows`` as in ``model_lists``."""
    validation, users, train = holdout
    lists = model_lists(catalog, sources, list_bound=list_bound, rows=rows)
    variants = [m for m, fam, _ in sources if fam == family]
    merged = family_from_files(catalog, lists, variants, family, weights, validation, list_bound=list_bound, rows=rows)
    top10 = top10_from_files(catalog, lists, weights, rows=rows)
    voters = [merged, *(lists[m] for m, fam, _ in sources if fam != family)]
    bound = list_bound and list_bound * len(sources)  # the merged list holds at most the books of its variants
    return final_vote_from_stages(catalog, voters, top10, validation, users, train, books, out_path, aux, cap, total_cap, list_bound=bound)


def holdout_stages(catalog: StageCatalog, inputs: Sequence[Stage], interactions: DataFrame, users: DataFrame) -> tuple[Stage, Stage, Stage]:
    """Validation truth, users and training borrows of ``interactions`` (O25),
    keyed by the ``inputs`` that they come from."""
    truth = catalog.stage("truth", lambda: ensemble.temporal_holdout(interactions)[0], inputs)
    validation = catalog.stage("validation", lambda: truth.frame.filter(F.col("split") == "validation").select(USER, BOOK), [truth])
    train = catalog.stage("train", lambda: ensemble.train_before(interactions, truth.frame), [truth, *inputs])
    return validation, catalog.stage("users", lambda: users, inputs), train
