"""Quality rules (operator 7): importance scores of hashed n-grams.

Words and pairs of neighbouring words are hashed into ``buckets`` counts, once
over all documents (the raw corpus) and once over the trusted ones.  Both are
multinomials; the trusted one is smoothed towards the raw one by ``smoothing``
pseudo-counts, by default ``SHARE`` times the trusted n-grams, so a verdict does
not depend on the sample's size.  A bucket weighs log(trusted / raw), in whole
millionths, and a document's score is the mean weight of its n-grams.
Documents below ``threshold`` are rejected, as are those that fail the base
rules (too few words, or too many words in repeated three-word windows).

With ``labels`` (id, quality, toxic) the threshold is fitted, and a second term
finds toxic documents, whose few toxic words a mean does not show.  Words (without
case and marks at their ends) that at least ``MIN_DOCS`` labelled toxic documents
of good quality hold, and clearly more often than clean ones, are a lexicon; they
weigh the log-ratio of their document frequencies, and a document's toxicity is
the sum over its distinct words, in the spellings that the labelled documents have.
The lexicon is a table of ``SLOTS`` short lists found by hash, so a word costs one
look-up however many entries there are.  Each limit is the one that maximises (share of good documents kept) - (share of
bad ones kept) over the labelled documents that pass the base rules, half-way to
the next labelled document: quality 1 against 0 for the score, and toxic 0
against 1 among quality 1 for the toxicity.  Without bad or good examples the
score's limit is ``threshold`` and toxicity has none.

All trusted and labelled documents are learned from, and all labelled ones fit
the limits.  Up to ``LABELS`` ids are sent to all tasks; more are joined with the
documents by a shuffle.

Counting aggregates map-side into at most ``buckets`` rows a task; the model is
one row of ``buckets`` numbers, and scoring is a map.  Labelled documents are
judged first and written with their figures, so that no document is judged
twice.  Only DataFrame functions are used.

Defined results: a null text has no words and no lines; documents without
words score 0; a null id is in no label; without trusted documents every score
is 0; repeated rows count and are judged each; an empty table gives an empty
result; ``keep_good`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballot.functions import bounded_broadcast
from ballot.llm.exprs import SPACES, let, words
from ballot.llm.graph import staged

BUCKETS = 1 << 14
#: Pseudo-counts for each trusted n-gram.
SHARE = 1.0
#: Without labels to fit it.
THRESHOLD = -0.2
#: Labelled toxic documents that a word of the lexicon is in at least.
MIN_DOCS = 3
#: Lists of the lexicon's table.
SLOTS = 1 << 16
MIN_WORDS = 50
#: Ids of labelled documents that are sent to all tasks; more are joined by a shuffle.
LABELS = 400_000
_UNIT = 1_000_000
MARKS = ".,;:!?\"'()[]"


def hashes(w: str | Column) -> Column:
    """The hash of each word: every later step compares and combines these."""
    return F.transform(w, lambda x: F.xxhash64(x))


def ngram_buckets(w: Column, buckets: int) -> Column:
    """The buckets of all words and neighbouring pairs of a word array."""
    return let(hashes(w), lambda h: _buckets(h, buckets))


def _buckets(h: Column, buckets: int) -> Column:
    one = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    left, right = F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0)))
    two = F.zip_with(left, right, lambda x, y: F.pmod(F.xxhash64(x, y), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def weights(docs: DataFrame, trusted: DataFrame, doc_id: str, text: str, buckets: int, smoothing: float | None) -> DataFrame:
    """One row: the array of bucket weights.  ``trusted`` has the ids."""
    ids = trusted.select(F.col(trusted.columns[0]).alias("_id")).dropna().distinct().withColumn("_good", F.lit(1))
    marked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("t")).join(bounded_broadcast(ids, LABELS), "_id", "left")
    grams = marked.select(F.coalesce("_good", F.lit(0)).alias("good"), F.explode(ngram_buckets(words(F.col("t")), buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good"))
    spark = docs.sparkSession
    full = spark.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0, ["raw", "good"])
    # the model: ``buckets`` rows, whatever the corpus
    model = full.agg(F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"), F.sort_array(F.collect_list(F.struct("b", "raw", "good"))).alias("m"))
    p_raw = lambda x: (x["raw"] + 1.0) / (F.col("n_raw") + float(buckets))
    extra = F.greatest(SHARE * F.col("n_good"), F.lit(1.0)) if smoothing is None else F.lit(smoothing)
    p_good = lambda x: (x["good"] + extra * p_raw(x)) / (F.col("n_good") + extra)
    return model.select(F.transform("m", lambda x: F.round(F.log(p_good(x) / p_raw(x)) * _UNIT).cast("int")).alias("weights"))


def score(h: Column, table: Column, buckets: int) -> Column:
    """Mean weight of the n-grams of an array of word hashes, in millionths."""
    total = lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))
    return let(_buckets(h, buckets), lambda g: F.when(F.size(g) > 0, total(g).cast("double") / F.size(g)).otherwise(F.lit(0.0)))


def n_repeat_words(h: Column) -> Column:
    """Words, given by their hashes, that lie in a three-word window found twice or more."""

    def of(t: Column) -> Column:  # t: window fingerprints in order
        at = F.transform(t, lambda x, i: F.struct(x.alias("x"), i.alias("i")))

        def places(s: Column) -> Column:
            twice = lambda e, i: ((i > 0) & (F.get(s, i - 1)["x"] == e["x"])) | F.coalesce(F.get(s, i + 1)["x"] == e["x"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, twice), lambda e: e["i"]))

        def covered(p: Column) -> Column:
            step = F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(3), F.get(p, j + 1) - x), F.lit(3)))
            return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

        repeated = F.size(F.array_distinct(t)) < F.size(t)
        return F.when(repeated, let(F.sort_array(at), lambda s: let(places(s), covered))).otherwise(F.lit(0).cast("long"))

    return let(h, lambda v: F.when(F.size(v) < 3, F.lit(0).cast("long")).otherwise(let(F.transform(F.sequence(F.lit(0), F.size(v) - 3), lambda i: F.xxhash64(F.get(v, i), F.get(v, i + 1), F.get(v, i + 2))), of)))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("long")


def lexicon(marked: DataFrame) -> DataFrame:
    """One row: the table of word hash and weight.  ``marked`` has the words ``w``
    of the labelled documents of good quality, and ``toxic``."""
    n = marked.agg(F.struct(F.sum(1 - F.col("toxic")).alias("n0"), F.sum("toxic").alias("n1")).alias("n"))
    bare = lambda x: F.xxhash64(F.btrim(F.lower(x), F.lit(MARKS)))
    each = marked.select("toxic", F.explode(F.array_distinct(F.transform("w", bare))).alias("x"))
    df = each.groupBy("x").agg(F.sum(1 - F.col("toxic")).alias("d0"), F.sum("toxic").alias("d1")).filter(F.col("d1") >= MIN_DOCS)
    both = df.withColumn("n", n.scalar())
    ratio = F.log((F.col("d1") + 0.5) / (F.col("n.n1") + 1)) - F.log((F.col("d0") + 0.5) / (F.col("n.n0") + 1))
    # three standard errors above no difference
    sure = F.col("r") - 3 * F.sqrt(1 / (F.col("d1") + 0.5) + 1 / (F.col("d0") + 0.5))
    best = both.withColumn("r", ratio).filter(sure > 0).select("x", F.round(F.col("r") * _UNIT).cast("long").alias("weight"))
    # its spellings in the labelled documents; words are few against documents
    forms = marked.select(F.explode(F.array_distinct("w")).alias("f")).groupBy("f").agg(F.lit(1)).select(bare(F.col("f")).alias("x"), F.xxhash64("f").alias("h"))
    return table_of(forms.join(best, "x"))


def table_of(entries: DataFrame) -> DataFrame:
    """One row: the lists (h, weight) of entries by slot; null where there are none."""
    slot = F.pmod("h", F.lit(SLOTS)).cast("int")
    lists = entries.groupBy(slot.alias("slot")).agg(F.sort_array(F.collect_set(F.struct("h", "x", "weight"))).alias("l"))
    every = entries.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(lists, "slot", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "l"))), lambda e: e["l"]).alias("lexicon"))


def toxicity(h: str | Column, table: Column) -> Column:
    """Sum of the lexicon's weights over the distinct words of an array of hashes, in millionths."""
    at = lambda h: F.get(table, F.pmod(h, F.lit(SLOTS)).cast("int"))
    near = F.filter(h, lambda x: at(x).isNotNull())
    hits = F.flatten(F.transform(F.array_distinct(near), lambda x: F.filter(at(x), lambda e: e["h"] == x)))
    # the spellings of a word count once
    once = F.array_distinct(F.transform(hits, lambda e: F.struct(e["x"].alias("x"), e["weight"].alias("weight"))))
    return F.aggregate(once, F.lit(0).cast("long"), lambda a, e: a + e["weight"])


def limit(judged: DataFrame, value: str, good: Column, bad: Column) -> DataFrame:
    """One row: the lowest ``value`` to keep, in whole thousandths of a nat; null without examples."""
    bins = judged.filter(good | bad).groupBy(F.floor(F.col(value) / (_UNIT // 1000)).alias("v")).agg(F.sum(good.cast("long")).alias("good"), F.sum(bad.cast("long")).alias("bad"))
    up = Window.orderBy("v")  # bins, not documents
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    gain = F.sum("good").over(rest) / F.sum("good").over(whole) - F.sum("bad").over(rest) / F.sum("bad").over(whole)
    halves = F.coalesce((F.col("v") + F.lag("v").over(up) + 1) / 2, F.col("v").cast("double")) * (_UNIT // 1000)
    cut = bins.withColumn("cut", halves).withColumn("gain", F.when((F.sum("good").over(whole) > 0) & (F.sum("bad").over(whole) > 0), gain))
    # of equal gains the lowest limit keeps most
    return cut.filter("gain is not null").agg(F.max_by("cut", F.struct("gain", -F.col("v"))).alias("cut"))


def judge(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, smoothing: float | None = None, threshold: float = THRESHOLD, labels: DataFrame | None = None) -> DataFrame:
    """``docs`` with a struct column ``_quality`` of the rules' figures and verdict."""
    model = staged(weights(docs, trusted, doc_id, text, buckets, smoothing), "quality-model")
    t = F.coalesce(F.col(text), F.lit(""))

    def figured(rows: DataFrame, toxic: Column) -> DataFrame:
        w = rows.withColumn("_words", words(t)).withColumn("_hashes", hashes("_words")).withColumn("_weights", model.scalar())
        if labels is not None:
            w = w.withColumn("_lexicon", table.scalar())
        return w.withColumn(
            "_quality",
            F.struct(
                F.size("_hashes").cast("long").alias("n_words"),
                F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                n_dup_lines(t).alias("n_dup_lines"),
                n_repeat_words(F.col("_hashes")).alias("n_repeat_words"),
                score(F.col("_hashes"), F.col("_weights"), buckets).alias("score"),
                toxic.alias("toxicity"),
            ),
        ).drop("_words", "_hashes", "_weights", "_lexicon")

    q = F.col("_quality")
    failed = base_failed(q["n_words"], q["n_repeat_words"])
    least, most = F.lit(threshold * _UNIT), F.lit(None).cast("double")
    if labels is None:
        figures = figured(docs, F.lit(0).cast("long"))
    else:
        name = labels.columns
        each = labels.select(F.col(name[0]).alias("_label_id"), F.col(name[1]).alias("quality"), F.col(name[2]).alias("toxic")).dropna().groupBy("_label_id").agg(F.struct(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).alias("_label"))
        each = bounded_broadcast(staged(each, "quality-labels"), LABELS)
        marked = docs.join(each, F.col(doc_id) == F.col("_label_id"), "left").drop("_label_id")
        labelled = marked.filter("_label is not null")
        table = staged(lexicon(labelled.filter("_label.quality = 1").select("_label.toxic", words(t).alias("w"))), "quality-lexicon")
        toxic = toxicity("_hashes", F.col("_lexicon"))
        # every labelled document is judged once: its row and figures are written for the limits and the result
        known = staged(figured(labelled, toxic), "quality-labelled")
        passed = known.filter(~failed).select("_label.quality", "_label.toxic", q["score"].alias("score"), (-q["toxicity"]).alias("clean"))
        good, bad = F.col("quality") == 1, F.col("quality") == 0
        least = F.coalesce(staged(limit(passed, "score", good, bad), "quality-limit").scalar(), least)
        most = staged(limit(passed, "clean", good & (F.col("toxic") == 0), good & (F.col("toxic") == 1)), "quality-limit").scalar()
        figures = known.unionByName(figured(marked.filter("_label is null"), toxic)).drop("_label")
    fine = (q["score"] >= least) & F.coalesce(-q["toxicity"] >= most, F.lit(True))
    return figures.withColumn("_quality", q.withField("base_failed", failed).withField("kept", ~failed & fine))


def base_failed(n: Column, repeated: Column) -> Column:
    return (n < MIN_WORDS) | (100 * repeated > 50 * n)


def keep_good(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that pass, columns as in ``docs``."""
    # packed, so no column of theirs meets a working column
    packed = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.struct(*docs.columns).alias("_row"))
    return judge(packed, trusted, "_id", "_text", **options).filter("_quality.kept").select("_row.*")
