"""Secret scans with corpus-wide ownership frequency (operator 9).

Candidates are found in every text: assignments, access keys, long
hexadecimal runs (the base kinds), and other long runs of letters and digits.
Each candidate's value is hashed, and over the whole corpus every hash gets
the number of distinct owners and of distinct repositories that hold it.
Values of more than ``max_owners`` owners or of more than ``max_repositories``
repositories are examples that were copied from one text to the next; the
others, of few owners and few repositories, look live.  All base spans stay; of the other
runs (kind ``token``) only live ones are added.

A regular expression's matches and the text between them (``split``) give
exact offsets in code points without Python.  Texts are only mapped; what is
shuffled is the candidates.  Owners are counted in three steps with map-side
aggregation (value, owner and repository; value and owner; value), so a value
that a third of all rows hold does not meet in one task; looking its counts up
is a join that Spark splits.

Only DataFrame functions are used.  Defined results: a null text is empty; a
null owner or repository is one like any other; repeated rows are scanned
each but count once; an empty table gives an empty result.  Other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballot.llm.graph import staged

KINDS = ("assign", "access", "hex", "token")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the same as the 20 or more of AKIA[A-Z0-9]+: both take the whole run
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Values that more owners or repositories hold are widely copied examples; two repositories for each owner.
MAX_OWNERS = 2
MAX_REPOSITORIES = 4
_SPAN = "struct<start:long,kind:int,end:long,value:string>"


def _spans(text: Column, kind: str, pattern: str, value: int) -> Column:
    """Matches as (start, kind, end, value), in order."""
    empty = F.array().cast(f"array<{_SPAN}>")
    cuts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(value)).alias("value"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["all"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).cast(f"array<{_SPAN}>").alias("out"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
    # the last gap has no match
    found = F.aggregate(F.filter(cuts, lambda x: x["all"].isNotNull()), begin, step, lambda a: a["out"])
    return F.when(text.rlike(pattern), found).otherwise(empty)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")


def find(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_base`` and ``_more``: arrays of (start, kind, end, value)."""
    t = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(_spans(t, "assign", ASSIGN, 2), lambda x: F.length(x["value"]) >= 6)
    base = F.concat(assign, _spans(t, "access", ACCESS, 0), _spans(t, "hex", HEX, 0))
    out = docs.withColumn("_base", F.sort_array(base))

    def secret_like(x: Column) -> Column:
        apart = ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        digits = F.length(F.regexp_replace(x["value"], "[^0-9]+", ""))
        return (digits >= 4) & x["value"].rlike("[A-Za-z]") & apart

    return out.withColumn("_more", F.filter(_spans(t, "token", TOKEN, 0), secret_like))


def ownership(candidates: DataFrame) -> DataFrame:
    """Per ``hash`` of (hash, owner, repository) rows: n_owners, n_repositories."""
    once = candidates.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("_one"))
    owners = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("_n"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("_n").alias("n_repositories"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, verdicts
    (``live`` or ``example``, as the spans), n_live, n_example, most_owners, most_repositories."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.col(owner).alias("owner"), F.col(repository).alias("repository"))
    found = find(rows, "_text").drop("_text")
    counts = [_count(F.col("_base"), k) for k in KINDS[:3]]
    hashed = F.transform(F.concat("_base", "_more"), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("hash")))
    # numbers are given before the write, so both uses below see the same ones
    found = staged(found.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "owner", "repository", *counts, F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), hashed.alias("_all")), "secrets")
    each = found.select("_row", "owner", "repository", F.explode("_all").alias("c")).select("_row", "owner", "repository", "c.*")
    judged = each.drop("owner", "repository").join(ownership(each), "hash").withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))
    judged = judged.filter((F.col("kind") < KINDS.index("token")) | F.col("live"))
    # one document's spans
    spans = judged.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("s"), F.max("n_owners").alias("most"), F.max("n_repositories").alias("most_in"))
    none = F.array().cast("array<struct<start:long,kind:int,end:long,live:boolean>>")
    s = F.coalesce("s", none)
    return (
        found.join(spans, "_row", "left")
        .select(
            "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", _joined(s).alias("spans"),
            F.array_join(F.transform(s, lambda x: F.when(x["live"], "live").otherwise("example")), ",").alias("verdicts"),
            F.size(F.filter(s, lambda x: x["live"])).cast("long").alias("n_live"),
            F.size(F.filter(s, lambda x: ~x["live"])).cast("long").alias("n_example"),
            F.coalesce("most", F.lit(0).cast("long")).alias("most_owners"),
            F.coalesce("most_in", F.lit(0).cast("long")).alias("most_repositories"),
        )
    )
