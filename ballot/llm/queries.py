"""The registered queries of the training-data operators.

Each takes ``(spark, sf_dir)``, runs its operator over the whole table with
production parameters, and returns the full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballot.llm import decontaminate, language_model, linededup, mixing, neardup, ngram_join, periodic, pii, quality, secret_scan, sharding, substring, whitening
from ballot.llm.exprs import let, words

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) leak."""
    return decontaminate.find_leaks(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability."""
    return language_model.score_documents(documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    return pii.find_pii(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines before dropping, dropped lines, and digest of what stays."""
    kept = linededup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in the mix."""
    return mixing.mix_report(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "taken")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard."""
    return sharding.assign_shards(documents(spark, sf_dir), "doc_id", SHARDS).select("doc_id", "n_chars", "slot", "shard")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies."""
    return neardup.near_duplicates(documents(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled sample: id, quality, toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents labelled as good and not toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and toxic = 0").select("doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's figures and verdict."""
    judged = quality.judge(documents(spark, sf_dir), trusted(spark, sf_dir), labels=labels(spark, sf_dir))
    return judged.select("doc_id", "_quality.*").withColumns({k: F.col(k) / 1_000_000 for k in ("score", "toxicity")})


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every removed unit or passage and the occurrence that stays."""
    return substring.removed(documents(spark, sf_dir)).drop("text_hash")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets and how many owners hold them.  An owner is a
    source, and every document is a repository of its own."""
    return secret_scan.scan(documents(spark, sf_dir), owner="source", repository="doc_id")


def periodic_text(doc_id: Column, text: Column) -> Column:
    """The text, of which one id in ten by its checksum repeats a part of itself
    from some word on.  The words are joined by one space."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)

        def filled(at: Column) -> Column:  # at: first word, period
            a, p = at["a"], at["p"]
            return F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))))

        start = (g % n).cast("int")
        return F.when(n > 0, let(F.struct(start.alias("a"), (1 + F.floor((n - start) / (3 + g % 8))).cast("int").alias("p")), filled)).otherwise(F.lit(""))

    return F.when(h % 10 == 0, let(words(text), repeated)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's repeated stretches of words, and the text without them."""
    docs = documents(spark, sf_dir)
    found = periodic.find_runs(docs.select("doc_id", periodic_text(F.col("doc_id"), F.col("text")).alias("text")))
    key = lambda r: F.struct(r["length"], -r["start"], -r["period"])
    best = F.get(F.array_sort("runs", lambda x, y: F.when(key(x) > key(y), -1).when(key(x) < key(y), 1).otherwise(0)), F.lit(0))
    every = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(every, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of the Jaccard join on four-word shingles."""
    return ngram_join.ngram_join(documents(spark, sf_dir))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's leading whitened components."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_pii": op3_pii,
    "op4_line_dedup": op4_line_dedup,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_embedding_whitening": op13_embedding_whitening,
}

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, {WS}), {AZ}) AS key FROM lines),
owner AS (SELECT key, min(doc_id) AS own FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT k.doc_id, k.line, k.pos, coalesce(o.own < k.doc_id, false) AS gone FROM keyed k LEFT JOIN owner o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
