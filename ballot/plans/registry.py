"""Named queries over the test tables: one per operator and pipeline.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
tables (no row caps, no id subsets).  Inputs are the real tables and the
planted prediction lists Spark derives from them (FIXTURES.md §2).  IO
operators write to a fresh folder under ``spark.checkpoint.dir`` and return
what they read back.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballot.functions import partitions_for
from ballot.operators import candidates as C
from ballot.operators import evaluate as E
from ballot.operators import layer1 as L1
from ballot.operators import layer2 as L2
from ballot.operators import learn as LR
from ballot.operators import prepare as P
from ballot.operators import propagate as PG
from ballot.operators import text as TX
from ballot.operators import weights as W
from ballot.plans import ensemble as PL
from ballot.plans import files as FP
from ballot.schema import AUX, BACKBONE, BOOK, FAMILY, MODEL, PREDICTIONS, RNK, USER, VOTES, WEIGHTS
from ballot.session import ROWS_A_PARTITION, partitions_by_rows, remove_path, scratch_path
from ballot.sources import io as IO
from ballot.sources import tables as TB
from ballot.sources.catalog import Stage, StageCatalog
from ballot.sources.fixture import FIXTURE_AUX, FIXTURE_MODELS, LIST_DEPTH, V5, fixture_weights, planted_predictions

# Fixed parameters of the registered queries.
CAP = 150_000  # aux weight cap, micro-votes
TOTAL_CAP = 400_000  # cap on the sum of aux weights, micro-votes
SUB3 = ["v5_01", "v5_02", "v5_03"]
TEXT_DIMS = (64, 128)
BACKBONE_27 = ["hybrid", "v5_01", "v5_02", "v5_03"]
CANDIDATES_27 = [m[1] for m in FIXTURE_MODELS if m[1] not in BACKBONE_27]
LIST_WEIGHTS = [("popular", 300_000, 1, BACKBONE), ("history", 200_000, 2, AUX), ("coborrow", 150_000, 3, AUX), ("emb64", 100_000, 4, AUX)]


class Ctx:
    """Lazy common inputs for one (session, scale) pair."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf
        self.inter = TB.tpch_interactions(spark, sf)
        self._derive(*E.temporal_holdout(self.inter))
        self.fw = fixture_weights(spark)
        self.users = TB.users(spark, sf)
        self.books = TB.books(spark, sf)
        self.items = TB.book_vectors(spark, sf)
        self.stages: list[str] = []

    def _derive(self, holdout: DataFrame, train: DataFrame) -> None:
        self.holdout, self.train = holdout, train
        self.truth = holdout.select(USER, BOOK)
        self.val = holdout.filter(F.col("split") == "validation").select(USER, BOOK)
        self.raw = planted_predictions(self.spark, self.sf, self.truth)
        # about the planted rows, for the number of partitions only
        rows = TB.table(self.spark, self.sf, "customer").count() * len(FIXTURE_MODELS) * LIST_DEPTH
        self.rows = rows
        partitions_by_rows(self.spark, max(rows, TB.table(self.spark, self.sf, "lineitem").count()))
        self.preds = P.conform(self.raw, list_bound=LIST_DEPTH, rows=rows)

    def stage_preds(self) -> None:
        """Write the conformed lists once, for queries that read them several times."""
        self.preds = self.staged(self.preds.select(*PREDICTIONS.fieldNames()), "conformed")

    def stage_val(self) -> None:
        """Write the validation truth once: a fit reads it several times."""
        self.val = self.staged(self.val, "validation")

    def votes(self) -> DataFrame:
        return L2.weighted_vote(self.preds, self.fw, k=1, validate="lazy", rows=self.rows // LIST_DEPTH)

    def picks(self) -> DataFrame:
        return L2.top1(self.votes())

    def p1(self) -> DataFrame:
        return PL.layer1_family(self.preds, self.fw, "v5", variants=V5, k=10, min_support=7, truth=self.val, list_bound=LIST_DEPTH)

    def p2(self) -> DataFrame:
        return PL.layer1_top10(self.preds, self.fw, k=10, validate="lazy", rows=self.rows)

    def voters(self) -> DataFrame:
        return L2.union_models([self.preds.filter(F.col(FAMILY) != "v5"), self.p1()])

    def stage_holdout(self) -> None:
        """Write the holdout once; the candidate jobs and the training read the
        stages instead of recomputing the joins.  The borrows themselves are
        written for as long as the holdout reads them."""
        base, inter = scratch_path(self.spark, "holdout"), scratch_path(self.spark, "inter")
        IO.write_stage(self.inter, inter)
        truth, self.train = PL.stage_holdout(self.spark.read.parquet(inter), base)
        remove_path(self.spark, inter)
        self.stages.append(f"{base}/train")
        self.holdout, self.truth = truth, truth.select(USER, BOOK)
        self.val = truth.filter(F.col("split") == "validation").select(USER, BOOK)

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written once and read back, its shuffle files removed."""
        path = scratch_path(self.spark, name)
        IO.write_stage(df, path)
        self.stages.append(path)
        return self.spark.read.parquet(path)

    def drop_stages(self) -> None:
        """Remove the stages written so far; for a job that has staged what it made of them."""
        while self.stages:
            remove_path(self.spark, self.stages.pop())

    def stage_inter(self) -> DataFrame:
        """All borrows, written once: the sequence jobs read them several times."""
        path = scratch_path(self.spark, "inter")
        IO.write_stage(self.inter, path)
        return self.spark.read.parquet(path)

    def list_weights(self) -> DataFrame:
        return W.weights_frame(self.spark, LIST_WEIGHTS)

    def candidate_lists(self) -> list[DataFrame]:
        pop = C.popularity_for_users(C.popularity_candidates(self.train, 10, self.users), self.users)
        return [
            pop,
            C.history_candidates(self.train, 10),
            C.coborrow_candidates(self.train, 10),
            C.embedding_variant(self.items, self.train, 64, 10),
        ]


def _q(fn: Callable[[Ctx], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Ctx(spark, sf_dir))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


# ------------------------------------------------------------------ sources


def o01_read_predictions(c: Ctx) -> DataFrame:
    """Planted lists written as one CSV folder per model, read back (O01)."""
    base = scratch_path(c.spark, "o01")
    c.raw.select(MODEL, USER, BOOK, "raw_score").write.partitionBy(MODEL).option("header", True).csv(base)
    fam = {m[1]: m[2] for m in FIXTURE_MODELS}
    sources = [(m, fam[m], f"{base}/model={m}") for m in sorted(fam)]
    return IO.read_predictions(c.spark, sources)


def o02_read_interactions(c: Ctx) -> DataFrame:
    """Borrows stored under foreign column names, read back canonically."""
    path = scratch_path(c.spark, "o02")
    c.inter.select(
        F.col(USER).alias("reader"), F.col(BOOK).alias("item"), F.col("ts").alias("borrowed_at"), F.col("seq").alias("n")
    ).write.parquet(path)
    return IO.read_interactions(c.spark, path, {USER: "reader", BOOK: "item", "ts": "borrowed_at", "seq": "n"})


def o03_write_submission(c: Ctx) -> DataFrame:
    path = scratch_path(c.spark, "o03")
    IO.write_submission(c.staged(c.picks(), "picks"), path)  # checked, then written
    return IO.read_submission(c.spark, path)


def o04_write_stage(c: Ctx) -> DataFrame:
    path = scratch_path(c.spark, "o04")
    IO.write_stage(c.votes(), path)
    return IO.read_stage(c.spark, path, VOTES)


# ------------------------------------------------------------------ prepare


def o05_conform(c: Ctx) -> DataFrame:
    return c.preds


def o06_standardize(c: Ctx) -> DataFrame:
    c.stage_preds()
    mm = P.standardize(c.preds, "minmax", "model", out="std_minmax")
    # both statistics of a model's file are taken before the joins by list
    zs = P.standardize(mm, "zscore", "model", out="_z")
    mu = P.standardize(zs, "minmax", "model_user", out="std_minmax_user")
    rk = P.standardize(mu, "rank", out="std_rank")
    # the engines' deviations differ in the last bit
    micro = F.floor(F.col("_z") * 1_000_000 + 0.5).cast("long").alias("zscore_micro")
    return rk.select(MODEL, USER, BOOK, RNK, "std_minmax", "std_minmax_user", "std_rank", micro)


def o07_calibrate(c: Ctx) -> DataFrame:
    """Both methods: bins and isotonic."""
    c.stage_preds()
    c.stage_val()
    both = P.calibrate(P.calibrate(c.preds, c.val, "bins", 10).withColumnRenamed("cal_score", "bin_score"), c.val, "isotonic")
    return both.select(MODEL, USER, BOOK, F.col("bin_score").alias("cal_score"), F.col("cal_score").alias("iso_score"))


def o08_model_weights(c: Ctx) -> DataFrame:
    return W.model_weights(c.preds, c.val, k=1, aux=FIXTURE_AUX)


def o08_bootstrap_weights(c: Ctx) -> DataFrame:
    return W.bootstrap_weights(c.preds, c.val, k=1, aux=FIXTURE_AUX, replicates=32, drop=2, seed=42)


def o09_cap_weights(c: Ctx) -> DataFrame:
    w = W.model_weights(c.preds, c.val, k=1, aux=FIXTURE_AUX)
    return W.cap_weights(w, CAP, TOTAL_CAP).select(MODEL, "weight", "priority", "role")


def o10_support_filter(c: Ctx) -> DataFrame:
    return L1.support_filter(c.preds, "v5", min_support=7, k=10)


def o11_consensus_filter(c: Ctx) -> DataFrame:
    return L2.consensus_filter(c.votes(), 2)


def o12_attach_weights(c: Ctx) -> DataFrame:
    return W.attach_weights(c.preds, c.fw, validate="lazy")


def o13_supplementary(c: Ctx) -> DataFrame:
    backbone = c.preds.filter(F.col(MODEL).isin(["hybrid"] + V5))
    return E.supplementary(c.preds.filter(F.col(MODEL) == "dspos2"), backbone, k=10)


def o14_cascade(c: Ctx) -> DataFrame:
    votes = c.votes()
    top10 = c.p2().filter(F.col(RNK) == 1).select(USER, BOOK, F.col("raw_score").cast("long").alias("score"))
    sources = [
        ("consensus", L2.top1(L2.consensus_filter(votes, 2))),
        ("vote", L2.top1(votes)),
        ("top10", top10),
    ] + C.cold_start_sources(c.users, c.train)
    return L2.cascade(sources)


def _of_all_and_three(of: Callable[[list[str]], DataFrame]) -> DataFrame:
    parts = [of(v).withColumn("variants", F.lit(len(v))) for v in (V5, SUB3)]
    return L2.union_models(parts)


def o15_variant_intersection(c: Ctx) -> DataFrame:
    """The books that all ten variants list, and those that the first three do."""
    return _of_all_and_three(lambda v: L1.variant_intersection(c.preds, "v5", k=10, variants=v))


def o16_union_models(c: Ctx) -> DataFrame:
    c.stage_preds()
    c.stage_val()
    return c.voters()


def o17_weighted_vote(c: Ctx) -> DataFrame:
    """Flat Top-1 ballots, and reciprocal Top-10 ballots."""
    flat = c.votes().withColumn("positional", F.lit("flat"))
    reciprocal = L2.weighted_vote(c.preds, c.fw, k=10, positional="reciprocal", validate="lazy", rows=c.rows)
    return flat.unionByName(reciprocal.withColumn("positional", F.lit("reciprocal")))


def o18_stable_boost(c: Ctx) -> DataFrame:
    c.stage_preds()
    fam = c.preds.filter(F.col(FAMILY) == "v5")
    votes = L2.weighted_vote(fam, c.fw, k=10, positional="linear")
    boost = L1.family_boost(c.fw, V5)
    return _of_all_and_three(lambda v: L1.stable_boost(votes, L1.variant_intersection(c.preds, "v5", k=10, variants=v), boost))


def o19_integrate_family(c: Ctx) -> DataFrame:
    return L1.integrate_family(c.preds, "v5", c.fw, variants=V5, k=10, min_support=7, truth=c.val, list_bound=LIST_DEPTH)


def o20_topk_fusion(c: Ctx) -> DataFrame:
    return L1.topk_fusion(c.preds, c.fw, k=10, validate="lazy", rows=c.rows)


def o21_arbitrate(c: Ctx) -> DataFrame:
    return L2.arbitrate(c.votes())


def o22_top1(c: Ctx) -> DataFrame:
    return c.picks()


def o23_decision_margin(c: Ctx) -> DataFrame:
    return L2.decision_margin(c.votes())


# ------------------------------------------------------------------ evaluate


def o24_hit_at_k(c: Ctx) -> DataFrame:
    return E.hit_at_k(c.preds, c.truth, k=1)


def o25_temporal_holdout(c: Ctx) -> DataFrame:
    return c.holdout


def o26_variant_stability(c: Ctx) -> DataFrame:
    return E.variant_stability(c.preds, "v5", k=10, variants=V5)


def o27_admission_scenarios(c: Ctx) -> DataFrame:
    return E.admission_scenarios(c.preds, c.fw, BACKBONE_27, CANDIDATES_27, c.val, cap=CAP)


def o28_admission_gate(c: Ctx) -> DataFrame:
    return E.admission_gate(c.preds, c.fw, BACKBONE_27, CANDIDATES_27, c.val, cap=CAP)


def o29_pair_lift(c: Ctx) -> DataFrame:
    before = L2.top1(L2.weighted_vote(c.preds.filter(F.col(MODEL).isin(BACKBONE_27)), c.fw, k=1))
    return E.pair_lift(before, c.picks(), c.truth)


def o30_submission_check(c: Ctx) -> DataFrame:
    return E.submission_check(L2.top1(L2.consensus_filter(c.votes(), 2)), c.users, c.books)


# ------------------------------------------------------------------ candidates


def o31_graph_propagate(c: Ctx) -> DataFrame:
    return C.graph_propagate(c.stage_inter(), k=10)


def o31_graph_layers(c: Ctx) -> DataFrame:
    """Two and three layers of propagation."""
    inter = c.stage_inter()
    shared = PG.propagation(inter, c.items, 16, 3, pool=50)
    return L2.union_models([PG.graph_layers(inter, c.items, 16, n, k=10, pool=50, shared=shared) for n in (2, 3)])


def o32_embedding_variant(c: Ctx) -> DataFrame:
    return C.embedding_variant(c.items, c.inter, 64, k=10)


def o33_text_embedding(c: Ctx) -> DataFrame:
    """Both dimensions the reference names; the exact sums as one string a book."""
    titles = c.books.select(BOOK, "title")
    sums = F.array_join(F.transform("sums", lambda x: x.cast("string")), ",")
    return L2.union_models(
        [
            TX.text_embedding(titles, "title", d, id_col=BOOK).select(F.lit(d).alias("dim"), BOOK, "norm", sums.alias("sums"))
            for d in TEXT_DIMS
        ]
    )


def o34_popularity_candidates(c: Ctx) -> DataFrame:
    return C.popularity_candidates(c.train, 10, c.users)


def o35_history_candidates(c: Ctx) -> DataFrame:
    return C.history_candidates(c.train, 10)


def o36_coborrow_candidates(c: Ctx) -> DataFrame:
    return C.coborrow_candidates(c.stage_inter(), 10)


def o37_hybrid_candidates(c: Ctx) -> DataFrame:
    # a stage a list: the check of the weights and the blend both read it
    c.stage_holdout()
    return C.hybrid_candidates([c.staged(x, "candidates") for x in c.candidate_lists()], c.list_weights(), k=10)


def o38_cold_start_fill(c: Ctx) -> DataFrame:
    picks = L2.top1(L2.consensus_filter(c.votes(), 3))
    return C.cold_start_fill(picks, c.users, c.train)


def _features(c: Ctx) -> DataFrame:
    # a stage a list, so that the shuffle files of one are gone before the next
    c.stage_holdout()
    cand = L2.union_models([c.staged(x.select(USER, BOOK), "candidates") for x in c.candidate_lists()])
    cos = C.embedding_variant(c.items, c.train, 64, k=None).select(USER, BOOK, F.col("raw_score").alias("cosine"))
    return LR.assemble_features(cand, c.train, c.users, c.staged(cos, "cosine"))


def o39_assemble_features(c: Ctx) -> DataFrame:
    return _features(c)


def _staged_features(c: Ctx) -> DataFrame:
    """The features, written once: fit and score both read the stage, and what they
    were made of (candidates, cosines, training borrows) is removed."""
    features, path = _features(c), scratch_path(c.spark, "features")
    IO.write_stage(features, path)
    c.drop_stages()
    return c.spark.read.parquet(path)


def o40_gbdt_scorer(c: Ctx) -> DataFrame:
    return LR.gbdt_scorer(_staged_features(c), c.val, seed=42, max_iter=10, max_depth=3)


def o40_gbdt_facts(c: Ctx) -> DataFrame:
    """What any right scorer's lists meet, user by user."""
    return LR.scorer_facts(c.staged(o40_gbdt_scorer(c), "scored"), c.val)


def o41_model_search(c: Ctx) -> DataFrame:
    return LR.model_search(_staged_features(c), c.val, {"maxDepth": [2, 3], "maxIter": [5, 10]}, seed=42)


def o41_search_facts(c: Ctx) -> DataFrame:
    """What any right search meets, rung by rung."""
    return LR.search_facts(o41_model_search(c))


# ------------------------------------------------------------------ pipelines


def _model_files(c: Ctx, truth: DataFrame | None = None) -> list[tuple[str, str, str]]:
    """The planted lists as one CSV folder a model: the pipelines' input files, as many
    as the rows need, whatever the shuffle partitions.  ``truth``: c.truth as a stage."""
    base = scratch_path(c.spark, "models")
    truth = c.staged(c.truth, "truth") if truth is None else truth.select(USER, BOOK)
    raw = planted_predictions(c.spark, c.sf, truth, partitions_for(truth, c.rows, ROWS_A_PARTITION))
    IO.write_stage(raw.select(MODEL, USER, BOOK, "raw_score"), base, fmt="csv", partition_by=[MODEL])
    return [(m[1], m[2], f"{base}/model={m[1]}") for m in FIXTURE_MODELS]


def _weight_rows(c: Ctx) -> list[tuple]:
    """The fixture's weights: one row a model."""
    return [tuple(r) for r in c.fw.select(*WEIGHTS.fieldNames()).collect()]


def _holdout(c: Ctx, catalog: StageCatalog) -> tuple[Stage, Stage, Stage]:
    tables = catalog.sources({t: f"{c.sf}/{t}.parquet" for t in ("orders", "lineitem", "customer")})
    return FP.holdout_stages(catalog, list(tables.values()), c.inter, c.users)


def p1_layer1_family(c: Ctx) -> DataFrame:
    """From the variants' files to the family's stage."""
    catalog = StageCatalog(c.spark, scratch_path(c.spark, "p1"))
    validation, _, _ = _holdout(c, catalog)
    files, each = _model_files(c, catalog.latest("truth").frame), c.rows // len(FIXTURE_MODELS)
    lists = FP.model_lists(catalog, [s for s in files if s[1] == "v5"], list_bound=LIST_DEPTH, rows=each)
    return FP.family_from_files(catalog, lists, V5, "v5", _weight_rows(c), validation, list_bound=LIST_DEPTH, rows=each).frame


def p2_layer1_top10(c: Ctx) -> DataFrame:
    """From all models' files to the Top-10 baseline's stage."""
    catalog = StageCatalog(c.spark, scratch_path(c.spark, "p2"))
    each = c.rows // len(FIXTURE_MODELS)
    lists = FP.model_lists(catalog, _model_files(c), list_bound=LIST_DEPTH, rows=each)
    return FP.top10_from_files(catalog, lists, _weight_rows(c), rows=each).frame


def p3_final_vote(c: Ctx) -> DataFrame:
    """From all models' files to the checked submission, read back."""
    catalog = StageCatalog(c.spark, scratch_path(c.spark, "p3"))
    out = scratch_path(c.spark, "p3-submission")
    holdout = _holdout(c, catalog)
    files = _model_files(c, catalog.latest("truth").frame)
    each = c.rows // len(FIXTURE_MODELS)
    return FP.run_files(
        catalog, files, "v5", _weight_rows(c), holdout, c.books, out, FIXTURE_AUX, CAP, TOTAL_CAP, LIST_DEPTH, each
    )


def p4_full_run(c: Ctx) -> DataFrame:
    c.stage_holdout()
    files, each = _model_files(c, c.truth), c.rows // len(FIXTURE_MODELS)
    planted = FP.read_lists(c.spark, files, list_bound=LIST_DEPTH, rows=each)
    return PL.full_run(
        planted, c.inter, c.items, c.users, c.fw, aux=FIXTURE_AUX, cap=CAP, total_cap=TOTAL_CAP, books=c.books,
        holdout=(c.holdout, c.train), list_bound=LIST_DEPTH, rows=c.rows,
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: _q(fn) for name, fn in sorted(globals().items()) if re.match(r"^[op]\d+_", name) and callable(fn)
}

__all__ = ["QUERIES", "Ctx", "PREDICTIONS", "WEIGHTS"]
