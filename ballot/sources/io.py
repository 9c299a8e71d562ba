"""O01 read_predictions, O02 read_interactions, O03 write_submission,
O04 write_stage / read_stage.

Prediction files are CSV with a header.  Columns are matched by header name,
never by position; every column is parsed with an explicit type and
``FAILFAST``, so a malformed value stops the job instead of turning into NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballot.schema import BOOK, FAMILY, MODEL, PREDICTION_FILE, RAW, RNK, USER
from ballot.session import freed_shuffles

_FILE_TYPES = {f.name: f.dataType for f in PREDICTION_FILE.fields}


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def _read_one(
    spark: SparkSession, model: str, family: str, path: str, fmt: str, schema: T.StructType | None, key_type: str
) -> DataFrame:
    types = dict(_FILE_TYPES)
    if key_type == "string":
        types[USER] = types[BOOK] = T.StringType()
    elif key_type != "long":
        raise ValueError("key_type must be 'long' or 'string'")
    if fmt == "csv":
        if schema is None:
            names = _header(spark, path)
            unknown = [n for n in names if n not in types]
            if unknown:
                raise ValueError(f"{path}: unknown columns {unknown}; expected some of {list(types)}")
            schema = T.StructType([T.StructField(n, types[n], True) for n in names])
        df = (
            spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", False)
            .option("mode", "FAILFAST")
            .csv(path)
        )
    elif fmt == "parquet":
        df = spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
    else:
        raise ValueError("fmt must be 'csv' or 'parquet'")
    cols = set(df.columns)
    if USER not in cols or BOOK not in cols:
        raise ValueError(f"{path}: needs {USER} and {BOOK} columns")
    if RAW not in cols and RNK not in cols:
        # No order information: only a one-pick-per-user file is meaningful.
        dup = df.groupBy(USER).count().filter(F.col("count") > 1).limit(1).count()
        if dup:
            raise ValueError(f"{path}: no score and no rank column, and more than one row per user")
    return df.select(
        F.lit(model).alias(MODEL),
        F.lit(family).alias(FAMILY),
        F.col(USER).cast(key_type).alias(USER),
        F.col(BOOK).cast(key_type).alias(BOOK),
        (F.col(RAW) if RAW in cols else F.lit(None)).cast("double").alias(RAW),
        (F.col(RNK) if RNK in cols else F.when(F.lit(RAW not in cols), F.lit(1))).cast("int").alias(RNK),
    )


def read_predictions(
    spark: SparkSession,
    sources: Sequence[tuple[str, str, str]],
    *,
    fmt: str = "csv",
    schema: T.StructType | None = None,
    key_type: str = "long",
) -> DataFrame:
    """Load each model's file into one long ``predictions`` frame.

    ``sources``: ``(model, family, path)``.  The model name comes from the
    list, not from the path.  File row order is never used as a rank.
    ``key_type``: 'long' (default) or 'string' user and book keys.
    """
    if not sources:
        raise ValueError("no sources")
    names = [s[0] for s in sources]
    if len(set(names)) != len(names):
        raise ValueError("model names must be unique")
    parts = [_read_one(spark, m, fam, p, fmt, schema, key_type) for m, fam, p in sources]
    return reduce(DataFrame.unionByName, parts)


def read_interactions(
    spark: SparkSession, path: str, columns: Mapping[str, str] | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Load borrowing events and project them to the canonical columns.

    ``columns`` maps canonical names (user_id, book_id, ts, seq) to source
    columns.  Only those columns are read (pruned scan).  ``seq`` defaults to 0.
    """
    columns = dict(columns or {USER: USER, BOOK: BOOK, "ts": "ts", "seq": "seq"})
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", False).option("mode", "FAILFAST")
    df = reader.load(path)
    return df.select(
        F.col(columns[USER]).cast("long").alias(USER),
        F.col(columns[BOOK]).cast("long").alias(BOOK),
        F.col(columns["ts"]).cast("timestamp_ntz").alias("ts"),
        (F.col(columns["seq"]) if "seq" in columns else F.lit(0)).cast("long").alias("seq"),
    )


def write_submission(
    picks: DataFrame,
    path: str,
    *,
    single_file: bool = False,
    user_col: str = USER,
    book_col: str = BOOK,
) -> None:
    """Write one row per user as CSV with a header.

    Refuses NULL keys and duplicate users (checked first, one aggregate).
    ``single_file`` funnels the output through one task; opt in only for a
    result that fits one task.
    """
    p = picks.select(F.col(USER).alias(user_col), F.col(BOOK).alias(book_col))
    bad = p.agg(
        F.sum(F.when(F.col(user_col).isNull() | F.col(book_col).isNull(), 1).otherwise(0)).alias("nulls"),
        (F.count(F.lit(1)) - F.count_distinct(user_col)).alias("dups"),
    ).collect()[0]
    if (bad["nulls"] or 0) > 0 or (bad["dups"] or 0) > 0:
        raise ValueError(f"submission refused: {bad['nulls']} null keys, {bad['dups']} duplicate users")
    out = p.coalesce(1) if single_file else p
    with freed_shuffles(picks.sparkSession):
        out.write.mode("overwrite").option("header", True).csv(path)


def read_submission(spark: SparkSession, path: str, user_col: str = USER, book_col: str = BOOK) -> DataFrame:
    schema = T.StructType([T.StructField(user_col, T.LongType()), T.StructField(book_col, T.LongType())])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def write_stage(df: DataFrame, path: str, *, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Persist a layer's result.  Parquet by default (pruned, typed reads)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt not in ("parquet", "csv"):
        raise ValueError("fmt must be 'parquet' or 'csv'")
    with freed_shuffles(df.sparkSession):
        w.parquet(path) if fmt == "parquet" else w.option("header", True).csv(path)


def read_stage(spark: SparkSession, path: str, schema: T.StructType, *, fmt: str = "parquet") -> DataFrame:
    """Reload a stage with an explicit schema."""
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
