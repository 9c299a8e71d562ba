"""Candidate generation re-aimed as Spark jobs: O31 graph_propagate,
O32 embedding_variant, O34 popularity_candidates, O35 history_candidates,
O36 coborrow_candidates, O37 hybrid_candidates, O38 cold_start_fill.

Every generator writes the canonical ``predictions`` columns (model, family,
user_id, book_id, raw_score, rnk).  Scores are integers where the contract
says so; ties break on the book key, so ranks are total.  Top-k filters sit
directly on ``row_number`` (WindowGroupLimit: a partial top-k before the
shuffle, so a heavy user never moves more than k rows per partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballot.functions import bounded_broadcast, partitions_for, safe_ratio
from ballot.functions.rank import HOT_LIST_ROWS, hot_groups, rank_within
from ballot.functions.small import MAX_BROADCAST_ROWS
from ballot.operators import sequences as steps
from ballot.operators.layer2 import cascade
from ballot.operators.prepare import standardize
from ballot.operators.weights import attach_weights
from ballot.schema import BOOK, FAMILY, MICRO, MODEL, PRIORITY, RAW, RNK, USER, WEIGHT
from ballot.session import freed_shuffles, remove_path, scratch_path


# Borrows whose links a task adds up: up to 20 each.
BORROWS_EACH = 100_000

# O36 scores users in up to SLICES jobs, one for each BORROWS_A_SLICE borrows:
# the neighbours that travel to the users are on disk for one slice at a time.
BORROWS_A_SLICE = 500_000
SLICES = 8


def _ranked(df: DataFrame, part: Sequence[str], order: Sequence[Column], k: int | None) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    r = df.withColumn(RNK, F.row_number().over(w).cast("int"))
    return r.filter(F.col(RNK) <= k) if k is not None else r


def _as_predictions(df: DataFrame, name: str, family: str, score: str) -> DataFrame:
    return df.select(
        F.lit(name).alias(MODEL),
        F.lit(family).alias(FAMILY),
        F.col(USER).cast("long").alias(USER),
        F.col(BOOK).cast("long").alias(BOOK),
        F.col(score).cast("double").alias(RAW),
        F.col(RNK).cast("int").alias(RNK),
    )


def _edges(train: DataFrame) -> DataFrame:
    return train.select(USER, BOOK).distinct()


# --------------------------------------------------------------------- O34


def popularity_candidates(train: DataFrame, k: int = 10, group: DataFrame | None = None) -> DataFrame:
    """Most borrowed books, overall or per user group.

    ``group``: optional ``(user_id, grp)``; borrows are counted per group of the
    borrowing user.  Order: count desc, last ts desc, book asc.
    Output (one list per group): grp, book_id, n, last_ts, rnk.
    """
    t = train.select(USER, BOOK, "ts")
    if group is not None:
        t = t.join(group.select(USER, "grp"), USER, "inner")
    else:
        t = t.withColumn("grp", F.lit("all"))
    counts = t.groupBy("grp", BOOK).agg(F.count(F.lit(1)).cast("long").alias("n"), F.max("ts").alias("last_ts"))
    order = [F.col("n").desc(), F.col("last_ts").desc_nulls_last(), F.col(BOOK).asc()]
    return _ranked(counts, ["grp"], order, k).select("grp", BOOK, "n", "last_ts", RNK)


def popularity_for_users(pop: DataFrame, users: DataFrame, name: str = "popular") -> DataFrame:
    """Hand each user the list of the user's group (``users``: user_id, grp)."""
    # k rows a group; the users' side is the one that grows
    j = users.select(USER, "grp").join(bounded_broadcast(pop), "grp", "inner")
    return _as_predictions(j, name, "popular", "n")


# --------------------------------------------------------------------- O35


def history_candidates(train: DataFrame, k: int = 10, name: str = "history") -> DataFrame:
    """A user's own past books by count, then recency, then book."""
    c = train.groupBy(USER, BOOK).agg(F.count(F.lit(1)).cast("long").alias("n"), F.max("ts").alias("last_ts"))
    order = [F.col("n").desc(), F.col("last_ts").desc_nulls_last(), F.col(BOOK).asc()]
    return _as_predictions(_ranked(c, [USER], order, k), name, "history", "n")


# ---------------------------------------------------- sequences of borrows


def first_borrows(train: DataFrame, path: str | None = None) -> DataFrame:
    """Distinct (user, book) borrows with ``_ts`` and ``_seq`` of the first one, written
    once (to ``path``): the sequences by user and by book and the checks for hot keys read them."""
    seq = F.min("seq") if "seq" in train.columns else F.lit(None).cast("long")
    path = path or scratch_path(train.sparkSession, "borrows")
    with freed_shuffles(train.sparkSession):
        train.groupBy(USER, BOOK).agg(F.min("ts").alias("_ts"), seq.alias("_seq")).write.parquet(path)
    return train.sparkSession.read.parquet(path)


def _borrow_order(key: str) -> list[Column]:
    other = BOOK if key == USER else USER
    return [F.col("_ts").asc_nulls_last(), F.col("_seq").asc_nulls_last(), F.col(other).asc()]


def borrow_sequence(train: DataFrame, key: str, out: str, hot_rows: int = HOT_LIST_ROWS) -> DataFrame:
    """Distinct (user, book) borrows numbered from 1 inside each ``key``.

    Order: first borrow (ts, then seq if there is one), then the other key.  A user or book
    of about ``hot_rows`` borrows or more is numbered across many tasks.
    """
    edges = train if "_ts" in train.columns else first_borrows(train)
    return rank_within(edges, [key], _borrow_order(key), out, hot_groups(edges, [key], hot_rows)).select(USER, BOOK, out)


def _by_user(train: DataFrame, parts: int) -> DataFrame:
    """Distinct borrows as in ``first_borrows``, dealt by user and sorted by place, in one shuffle."""
    seq = F.min("seq") if "seq" in train.columns else F.lit(None).cast("long")
    keyed = train.withColumns({c: F.col(c).cast("long") for c in (USER, BOOK)}).repartition(parts, USER)
    edges = keyed.groupBy(USER, BOOK).agg(F.min("ts").alias("_ts"), seq.alias("_seq"))
    return edges.sortWithinPartitions(USER, *_borrow_order(USER))


def adjacent(seq: DataFrame, key: str, pos: str, window: int, keep: str, out: str) -> DataFrame:
    """Each borrow with those at most ``window`` places before or after it in
    the sequence of ``key``: ``keep`` of the other as ``out``, ``_gap`` places
    away.  At most 2 x window rows per borrow, for every user and book alike:
    the join key (key, place) is unique, so it has no hot value."""
    offsets = F.array(*[F.lit(j) for j in range(-window, window + 1) if j])
    near = seq.withColumn("_j", F.explode(offsets)).withColumn("_at", F.col(pos) + F.col("_j"))
    other = seq.select(F.col(key).alias("_k"), F.col(pos).alias("_p"), F.col(keep).alias(out))
    joined = near.join(other, (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_p")))
    return joined.withColumn("_gap", F.abs("_j")).drop("_j", "_at", "_k", "_p")


# --------------------------------------------------------------------- O36


def coborrow_pairs(
    train: DataFrame, window: int = 5, neighbours: int = 20, hot_rows: int = HOT_LIST_ROWS, any_hot: bool | None = None
) -> DataFrame:
    """(b1, b2, cnt): for each book the ``neighbours`` books that most users
    borrowed at most ``window`` places before or after it (ties: book asc).

    A borrow's links travel to its book as one row; with users or books of about
    ``hot_rows`` borrows or more they are joined and counted link by link instead,
    so that no key is held by one task (``any_hot``: whether there are, if known).
    """
    if _any_hot(train, hot_rows) if any_hot is None else any_hot:
        edges = train if "_ts" in train.columns else first_borrows(train)
        links = adjacent(borrow_sequence(edges, USER, "_pos", hot_rows), USER, "_pos", window, BOOK, "b2").select(F.col(BOOK).alias("b1"), "b2")
        return _most_linked(links, neighbours)
    parts = _parts(train, train.count())
    lists = _neighbours(_sequences(train, parts), window, neighbours, parts)
    return lists.select("b1", F.inline(F.arrays_zip(F.col("_b2").alias("b2"), F.col("_cnt").alias("cnt"))).alias("b2", "cnt"))


def _sequences(train: DataFrame, parts: int) -> DataFrame:
    """One row a user: the books ``_books`` in the order of their first borrows."""
    return _by_user(train, parts).select(USER, BOOK).mapInArrow(steps.sequences, f"{USER} long, _books array<long>")


def _neighbours(sequences: DataFrame, window: int, most: int, parts: int) -> DataFrame:
    """One row a book: the books ``_b2`` linked ``most``, with their counts ``_cnt``."""
    links = sequences.mapInArrow(steps.links(window), "b1 long, _b2 array<long>").repartition(parts, "b1")
    return links.mapInArrow(steps.neighbours(most), "b1 long, _b2 array<long>, _cnt array<long>")


def _most_linked(links: DataFrame, neighbours: int) -> DataFrame:
    counts = links.groupBy("b1", "b2").agg(F.count(F.lit(1)).cast("long").alias("cnt"))
    return _ranked(counts, ["b1"], [F.col("cnt").desc(), F.col("b2").asc()], neighbours).drop(RNK)


def _parts(df: DataFrame, rows: int) -> int:
    """Partitions of about ``BORROWS_EACH`` of ``rows`` borrows, as many for each core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return -(-partitions_for(df, rows, BORROWS_EACH) // cores) * cores


def _any_hot(edges: DataFrame, hot_rows: int) -> bool:
    return any(hot_groups(edges, [key], hot_rows) is not None for key in (USER, BOOK))


def _best(cast: DataFrame, k: int, own: bool, name: str, family: str) -> DataFrame:
    """``cast`` (user, _b2, _w[, _own]), all of a user in one partition, as lists of the ``k`` best."""
    found = cast.mapInArrow(steps.best(k, own), f"{USER} long, {BOOK} long, {RAW} double, {RNK} int")
    return found.select(F.lit(name).alias(MODEL), F.lit(family).alias(FAMILY), USER, BOOK, RAW, RNK)


def coborrow_candidates(
    train: DataFrame, k: int = 10, window: int = 5, neighbours: int = 20, name: str = "coborrow", hot_rows: int = HOT_LIST_ROWS
) -> DataFrame:
    """Books borrowed close to the user's books, excluding the user's own.

    score(u, b) = sum over the user's books b' of cnt(b', b), for b among the
    neighbours of b'.  Every borrow takes part; rows are at most borrows x
    2 window for the counts and borrows x neighbours for the scores.
    Order: score desc, book asc.

    A borrow's neighbours travel to its user as one row with its own book; links are
    counted and scores added up by ``operators.sequences``, hot keys as in ``coborrow_pairs``.
    Each user's sequence and each book's neighbours are written once, users are scored slice by
    slice (``BORROWS_A_SLICE``) and the lists read back; a slice's shuffle files go when it is written.
    """
    spark = train.sparkSession
    if _any_hot(train, hot_rows):
        edges = first_borrows(train)
        e, pairs = edges.select(USER, BOOK), coborrow_pairs(edges, window, neighbours, hot_rows, True)
        cast = e.join(pairs, e[BOOK] == pairs["b1"]).select(USER, F.col("b2").alias(BOOK), "cnt")
        scored = cast.groupBy(USER, BOOK).agg(F.sum("cnt").cast("long").alias("score")).join(e, [USER, BOOK], "left_anti")
        return _as_predictions(_ranked(scored, [USER], [F.col("score").desc(), F.col(BOOK).asc()], k), name, "coborrow", "score")
    rows = train.count()
    parts, slices = _parts(train, rows), max(1, min(SLICES, -(-rows // BORROWS_A_SLICE)))
    borrows, near, out = (scratch_path(spark, n) for n in ("borrows", "neighbours", "coborrow"))
    with freed_shuffles(spark):
        _sequences(train, parts).write.parquet(borrows)
        sequences = spark.read.parquet(borrows)
        _neighbours(sequences, window, neighbours, parts).filter("b1 IS NOT NULL").write.parquet(near)
        for i in range(slices):
            some = sequences.filter(F.pmod(F.xxhash64(USER), F.lit(slices)) == i)
            # an own book without neighbours is marked all the same; a null user owns nothing
            own = some.select(USER, F.explode("_books").alias("_book")).withColumn("_own", F.when(F.col(USER).isNotNull(), F.col("_book")))
            cast = own.join(spark.read.parquet(near), F.col("_book") == F.col("b1"), "left").select(USER, "_b2", F.col("_cnt").alias("_w"), "_own")
            lists = _best(cast.repartition(_parts(train, -(-rows // slices)), USER), k, True, name, "coborrow")
            lists.write.mode("append").parquet(out)
    for path in (borrows, near):
        remove_path(spark, path)
    return spark.read.parquet(out)


# --------------------------------------------------------------------- O31


def graph_propagate(train: DataFrame, k: int = 10, window: int = 2, name: str = "graph", hot_rows: int = HOT_LIST_ROWS) -> DataFrame:
    """Two-hop user -> book -> user -> book score (a GNN stand-in).

    From each of the user's books b' to the readers at most ``window`` places
    before or after the user in the book's sequence of readers, and on to the
    books at most ``window`` places from b' in such a reader's own sequence.
    A path weighs (window + 1 - |places between readers|) x
    (window + 1 - |places between books|); score(u, b) is the sum over its
    paths.  Every borrow takes part, with at most (2 window)^2 paths each, so
    a popular book or a heavy reader costs no more than any other borrow.
    Order: score desc, book asc.

    A borrow first gets the books beside it in its reader's sequence, then those
    of the borrows beside it in the book's sequence, and its paths travel to the
    user as one row (``operators.sequences``).  With users or books of about ``hot_rows``
    borrows or more the links are joined by place instead, so that no key is held by one task.
    """
    if _any_hot(train, hot_rows):
        edges = first_borrows(train)
        near = lambda gap: (F.lit(window + 1) - gap).cast("long")
        by_book = borrow_sequence(edges, BOOK, "_pos", hot_rows)
        by_user = borrow_sequence(edges, USER, "_pos", hot_rows)
        readers = adjacent(by_book, BOOK, "_pos", window, USER, "u2")
        readers = readers.select(USER, F.col(BOOK).alias("b1"), "u2", near(F.col("_gap")).alias("_w1"))
        books = adjacent(by_user, USER, "_pos", window, BOOK, "b2")
        books = books.select(F.col(USER).alias("u2"), F.col(BOOK).alias("b1"), "b2", near(F.col("_gap")).alias("_w2"))
        paths = readers.join(books, ["u2", "b1"]).select(USER, F.col("b2").alias(BOOK), (F.col("_w1") * F.col("_w2")).alias("w"))
        scored = paths.groupBy(USER, BOOK).agg(F.sum("w").cast("long").alias("score"))
        return _as_predictions(_ranked(scored, [USER], [F.col("score").desc(), F.col(BOOK).asc()], k), name, "graph", "score")
    parts = _parts(train, train.count())
    edges = _by_user(train, parts)
    lists = T.StructType.fromDDL("_b2 array<long>, _w array<int>").fields
    own = edges.mapInArrow(steps.books_beside(window), T.StructType([*edges.schema.fields, *lists]))
    by_book = own.repartition(parts, BOOK).sortWithinPartitions(BOOK, *_borrow_order(BOOK)).select(USER, BOOK, "_b2", "_w")
    ways = by_book.mapInArrow(steps.paths(window), f"{USER} long, _b2 array<long>, _w array<int>")
    return _best(ways.repartition(parts, USER), k, False, name, "graph")


# --------------------------------------------------------------------- O32


def quantized_vectors(items: DataFrame, dim: int) -> DataFrame:
    """(book_id, _bv): floor(double(x) * 10^6) as LONG of the first ``dim``
    components, 0 where the vector is shorter.  Items without a vector are out."""
    q = lambda i: F.coalesce(F.floor(F.get("embedding", F.lit(i)).cast("double") * MICRO).cast("long"), F.lit(0).cast("long"))
    some = items.filter(F.size("embedding") > 0)
    return some.select(BOOK, F.array(*[q(i) for i in range(dim)]).alias("_bv"))


_HALF = 20  # bits of the low part of a profile component


def _sum_products(a: str, b: str, fa, fb) -> Column:
    prods = F.zip_with(F.col(a), F.col(b), lambda x, y: fa(x) * fb(y))
    return F.aggregate(prods, F.lit(0).cast("long"), lambda acc, x: acc + x).cast("decimal(38,0)")


def _high(x: Column) -> Column:
    return F.shiftright(x, _HALF)


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << _HALF) - 1).cast("long"))


def _same(x: Column) -> Column:
    return x


def _profile_dot(p: str, q: str) -> Column:
    """Exact dot product of a profile and a book vector: the profile's high and
    low parts are summed as LONG and put together as DECIMAL."""
    return _sum_products(p, q, _high, _same) * F.lit(1 << _HALF) + _sum_products(p, q, _low, _same)


def _profile_norm(p: str) -> Column:
    cross = _sum_products(p, p, _high, _low) * F.lit(1 << (_HALF + 1))
    return _sum_products(p, p, _high, _high).cast("decimal(26,0)") * F.lit(1 << (2 * _HALF)).cast("decimal(13,0)") + cross + _sum_products(p, p, _low, _low)


def embedding_variant(
    items: DataFrame, train: DataFrame, dim: int, k: int | None = 10, name: str | None = None
) -> DataFrame:
    """User profile from book vectors cut to ``dim``; rank own books by cosine.

    profile(u) = sum over borrows of the quantised book vector; dot products
    and squared norms are exact (DECIMAL from LONG parts, good for some 10^8
    borrows of a user); the cosine is one double division at the end:
    dot / sqrt(|p|^2 * |q|^2).  Candidates are the user's own books that have a
    vector.  Order: cosine desc (NULL last), book asc.

    Where the books with a vector are few enough to be sent to all tasks, borrows of others
    go before anything is shuffled.  One row per borrowed (user, book) joins its vector; the profile is ``dim``
    sums in one aggregate by user.  Nothing is exploded by component.
    """
    vectors = quantized_vectors(items, dim)
    known = vectors.select(BOOK).distinct()
    if known.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:  # else they would be shuffled once more
        train = train.join(F.broadcast(known), BOOK, "left_semi")
    counts = train.groupBy(USER, BOOK).agg(F.count(F.lit(1)).cast("long").alias("_c"))
    own = counts.join(vectors, BOOK)
    sums = [F.sum(F.col("_c") * F.get("_bv", F.lit(i))).cast("long").alias(f"_p{i}") for i in range(dim)]
    profile = own.groupBy(USER).agg(*sums).select(USER, F.array(*[f"_p{i}" for i in range(dim)]).alias("_pv"))
    profile = profile.withColumn("_nu", _profile_norm("_pv").cast("double"))
    norm = F.aggregate(F.transform("_bv", lambda x: x * x), F.lit(0).cast("long"), lambda acc, x: acc + x)
    cos = safe_ratio(_profile_dot("_pv", "_bv"), F.sqrt(F.col("_nu") * norm.cast("double")))
    scored = own.join(profile, USER).select(USER, BOOK, cos.alias("cosine"))
    ranked = _ranked(scored, [USER], [F.col("cosine").desc_nulls_last(), F.col(BOOK).asc()], k)
    return _as_predictions(ranked, name or f"emb{dim}", "emb", "cosine")


# --------------------------------------------------------------------- O37


def hybrid_candidates(lists: Sequence[DataFrame], weights: DataFrame, k: int = 10, name: str = "hybrid") -> DataFrame:
    """Weighted blend of candidate lists: scores are standardised inside each
    list's Top-k (O06, by rank), a ballot is worth floor(weight * std_score)
    micro-votes, and the sums are ranked in the arbitration order (O17, O21)."""
    from ballot.operators.layer2 import arbitrate, union_models

    top = union_models(list(lists)).filter(F.col(RNK) <= k)
    # lengths, votes and ranks all reuse the exchange by user
    cast = standardize(attach_weights(top, weights).repartition(USER), "rank", out="_std", list_bound=k)
    cast = cast.select(USER, BOOK, F.floor(F.col(WEIGHT) * F.col("_std")).alias("value"), PRIORITY)
    votes = cast.groupBy(USER, BOOK).agg(
        F.sum("value").cast("long").alias("score"),
        F.count(F.lit(1)).cast("long").alias("support"),
        F.min(PRIORITY).cast("int").alias("best_priority"),
    )
    fused = arbitrate(votes).filter(F.col("arb_rank") <= k)
    names = F.lit(name).alias(MODEL), F.lit("hybrid").alias(FAMILY)
    return fused.select(*names, USER, BOOK, F.col("score").cast("double").alias(RAW), F.col("arb_rank").cast("int").alias(RNK))


# --------------------------------------------------------------------- O38


def cold_start_sources(users: DataFrame, train: DataFrame, group: bool = True) -> list[tuple[str, DataFrame]]:
    """Fallback sources for ``cascade``: the group's most popular book, then
    the global most popular book.  ``users``: user_id[, grp]."""
    sources = []
    if group and "grp" in users.columns:
        gtop = popularity_candidates(train, 1, users).select("grp", BOOK, F.col("n").alias("score"))
        sources.append(("group_top", users.select(USER, "grp").join(bounded_broadcast(gtop, cache=True), "grp", "inner").select(USER, BOOK, "score")))
    # Global top book as one scalar subquery: no join, no copy of a table per user.
    top = popularity_candidates(train, 1).select(F.struct(BOOK, F.col("n").alias("score"))).scalar()
    sources.append(
        (
            "global_top",
            users.select(USER).select(
                USER, top[BOOK].alias(BOOK), top["score"].alias("score")
            ),
        )
    )
    return sources


def cold_start_fill(picks: DataFrame, users: DataFrame, train: DataFrame, group: bool = True) -> DataFrame:
    """Every user gets a pick: own pick, else the group's most popular book,
    else the global most popular book.  ``users``: user_id[, grp]."""
    return cascade([("pick", picks)] + cold_start_sources(users, train, group))
