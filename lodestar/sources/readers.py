"""Sources: JSON lines, CSV, Parquet, vectors, prior results. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.columns import to_number

_BAD = "_malformed"

_KINDS = {"s": T.StringType(), "a": T.ArrayType(T.StringType()), "d": T.DoubleType(), "l": T.LongType(), "b": T.BooleanType()}


def _schema(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in fields.items()])


META_SCHEMA = _schema(parent_asin="s", title="s", description="a", features="a", price="s", store="s", categories="a", average_rating="d", rating_number="l")
REVIEW_SCHEMA = _schema(user_id="s", parent_asin="s", rating="d", text="s", timestamp="l", helpful_vote="l", verified_purchase="b")
INTERACTION_COLUMNS = ["user_id", "parent_asin", "rating", "timestamp", "history"]


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed) of a (compressed) JSON-lines path, projected to ``schema``: missing keys are null, blank lines skipped, malformed lines kept apart.

    A single gzip file is one partition; ``partitions`` spreads its rows for the stages after it. ``malformed`` holds the raw lines.
    """
    with_bad = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("r")).select("r.*")
    rows = parsed.filter(F.col(_BAD).isNull()).drop(_BAD)
    bad = parsed.filter(F.col(_BAD).isNotNull()).select(F.col(_BAD).alias("line"))
    return (rows.repartition(partitions) if partitions else rows), bad


def _require(schema: T.StructType, *keys: str) -> None:
    missing = [k for k in keys if k not in schema.names]
    if missing:
        raise ValueError(f"required fields are missing: {missing}")


def read_meta(spark: SparkSession, path: str, schema: T.StructType = META_SCHEMA) -> DataFrame:
    _require(schema, "parent_asin")
    return read_json_lines(spark, path, schema)[0]


def read_reviews(spark: SparkSession, path: str, schema: T.StructType = REVIEW_SCHEMA) -> DataFrame:
    _require(schema, "user_id", "parent_asin")
    return read_json_lines(spark, path, schema)[0]


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).filter(F.trim("value") != "").count()


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header (optionally gzipped): read as strings by header name, rating and timestamp coerced; a missing column raises."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    _require(raw.schema, *INTERACTION_COLUMNS)
    return raw.select("user_id", "parent_asin", to_number(F.col("rating")).alias("rating"), to_number(F.col("timestamp")).alias("timestamp"), F.coalesce("history", F.lit("")).alias("history"))


def read_columns(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """Parquet, only those of ``wanted`` that exist (all without a list)."""
    df = spark.read.parquet(path)
    return df if wanted is None else df.select(*[c for c in wanted if c in df.columns])


def read_rows_of(spark: SparkSession, path: str, column: str, values: list, wanted: list[str] | None = None) -> DataFrame:
    """Parquet rows whose ``column`` is one of ``values``; the condition reaches the scan."""
    return read_columns(spark, path, wanted).filter(F.col(column).isin(values))


def read_vectors(spark: SparkSession, path: str, dimension: int, id_column: str = "id") -> DataFrame:
    """(item, vec) of a vector table; vectors of another length are left out."""
    return spark.read.parquet(path).select(F.col(id_column).cast("string").alias("item"), F.col("embedding").alias("vec")).filter(F.size("vec") == dimension)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system it names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(conf).exists(p))


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a path, if it exists, from the file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Replace a small file in the file system its path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_vectors_if_any(spark: SparkSession, path: str, dimension: int, id_column: str = "user_id") -> DataFrame | None:
    return read_vectors(spark, path, dimension, id_column) if exists(spark, path) else None


def read_npy_vectors(spark: SparkSession, matrix: str, ids: str) -> DataFrame:
    """(item, vec) from a matrix file and an id file, aligned by position (an exchange format for matrices that fit one machine)."""
    import numpy as np

    x, names = np.load(matrix, mmap_mode="r"), np.load(ids, allow_pickle=False)
    if len(x) != len(names):
        raise ValueError("matrix and ids differ in length")
    return spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in zip(names, x)], "item string, vec array<float>")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
