"""O33 text_embedding: tf-idf under a seeded sparse random projection.

Each distinct token gets ``hits`` of the ``dim`` components, one in each of
``hits`` equal blocks, with a sign; both come from the md5 of the seed and the
token.  A text's component is the sum over its tokens of +-idf, so inner
products of projections estimate those of the tf-idf vectors without bias.
idf is a whole number (thousandths), so the sums are exact: they depend neither
on the partitioning nor on the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballot.functions.small import bounded_broadcast, partitions_for, scalar_count

SPACE = r"[\x20\x09-\x0D]+"
HITS = 8  # components a token reaches; four hex digits of its md5 each
IDF_UNIT = 1000
TEXTS_EACH = 20_000  # texts whose sums a task holds


def token_projection(docs: DataFrame, dim: int, hits: int = HITS, seed: int = 0) -> DataFrame:
    """One row a distinct token of ``docs._words``: _token, _idf (thousandths of
    1 + ln((n + 1) / (rows with the token + 1))) and its places _at0.. in the
    blocks; a negative sign is kept as ``-place - 1``."""
    if not 1 <= hits <= HITS or dim % hits:
        raise ValueError(f"dim must be a multiple of hits, and hits at most {HITS}")
    block = dim // hits
    seen = docs.select(F.explode(F.array_distinct("_words")).alias("_token")).filter(F.col("_token") != "")
    counts = seen.groupBy("_token").agg(F.count(F.lit(1)).alias("_rows"))
    ratio = (scalar_count(docs) + 1) / (F.col("_rows") + 1)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_token")))
    places = []
    for j in range(hits):
        v = F.conv(F.substring(digest, 4 * j + 1, 4), 16, 10).cast("int")
        place = F.shiftright(v, 1) % block
        places.append(F.when(v % 2 == 1, -place - 1).otherwise(place).cast("int").alias(f"_at{j}"))
    idf = (F.floor(F.log(ratio) * IDF_UNIT + 0.5) + IDF_UNIT).cast("long")
    return counts.select("_token", idf.alias("_idf"), *places)


def text_embedding(
    df: DataFrame, text_col: str, dim: int = 64, id_col: str | None = None, hits: int = HITS, seed: int = 0
) -> DataFrame:
    """Text -> projected tf-idf vector of ``dim`` components.

    Output: the key (``id_col``, or all columns but the text), ``sums``
    ARRAY<LONG> (exact, thousandths), ``norm`` DOUBLE, and ``embedding``
    ARRAY<FLOAT>, the sums at length 1 (all zero where the text is null or has
    no token).  Tokens are lower-cased and split at white space.  Rows of one
    key are one text; idf counts rows.

    The vocabulary is counted with map-side combination and, within the bound
    of ``bounded_broadcast``, broadcast: then the texts are shuffled by key, as many
    to a task for any input, and summed there.  Beyond the bound tokens are joined by sort-merge, where AQE splits a hot token.
    """
    keys = [id_col] if id_col else [c for c in df.columns if c != text_col]
    words = F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), SPACE)
    docs = df.select(*[F.col(f"`{k}`") for k in keys], words.alias("_words"))
    vocabulary = bounded_broadcast(token_projection(docs, dim, hits, seed), cache=True)
    # texts are dealt by key and by their number: a task holds the sums of about TEXTS_EACH of them
    dealt = docs.repartition(partitions_for(docs, docs.count(), TEXTS_EACH), *[F.col(f"`{k}`") for k in keys])
    tokens = dealt.select(*[F.col(f"`{k}`") for k in keys], F.explode("_words").alias("_token"))
    block = dim // hits
    sums = []
    for c in range(dim):
        at = F.col(f"_at{c // block}")
        place = c % block
        value = F.when(at == place, F.col("_idf")).when(at == -place - 1, -F.col("_idf")).otherwise(F.lit(0).cast("long"))
        sums.append(F.sum(value).alias(f"_s{c}"))
    summed = tokens.join(vocabulary, "_token", "left").groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*sums)
    out = summed.select(*[F.col(f"`{k}`") for k in keys], F.array(*[F.col(f"_s{c}") for c in range(dim)]).alias("sums"))
    # squares as doubles: a long text's would not fit a LONG
    square = lambda acc, x: acc + x.cast("double") * x.cast("double")
    out = out.withColumn("norm", F.sqrt(F.aggregate("sums", F.lit(0.0), square)))
    unit = lambda x: F.coalesce(F.try_divide(x.cast("double"), F.col("norm")), F.lit(0.0)).cast("float")
    return out.select(*[F.col(f"`{k}`") for k in keys], "sums", "norm", F.transform("sums", unit).alias("embedding"))
