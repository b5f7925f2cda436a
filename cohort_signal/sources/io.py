"""Sources and sinks.

Reads are lazy ``spark.read`` calls; validation looks at ``df.columns`` on the
driver and never runs a job.  Sinks are plain ``df.write`` calls.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The tokens a default CSV reader of the reference's toolkit
# (pandas ``read_csv``) turns into a missing value, matched on the raw field.
DEFAULT_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    raise ValueError(f"unsupported format {fmt!r}")


def require_columns(df: DataFrame, required: Iterable[str], what: str) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} must contain columns {missing}; found {df.columns}")
    return df


def read_assessments(spark: SparkSession, path: str, fmt: str = "parquet",
                     key: str = "entity_id") -> DataFrame:
    """Wide assessment table, validated for its key column."""
    return require_columns(_read(spark, path, fmt), [key], "assessment table")


def with_types(df: DataFrame, schema: StructType) -> DataFrame:
    """A table of texts with the names and types of ``schema``."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_outcomes(spark: SparkSession, path: str, fmt: str = "parquet",
                  key: str = "entity_id", outcome: str = "outcome") -> DataFrame:
    """Outcome table, validated for key and outcome columns."""
    return require_columns(_read(spark, path, fmt), [key, outcome], "outcome table")


def read_raw_gradebook(spark: SparkSession, path: str, keep_na_text: bool = False,
                       na_tokens: Iterable[str] = DEFAULT_NA_TOKENS) -> DataFrame:
    """Read a gradebook CSV with every column as string.

    ``keep_na_text=False`` maps the default NA tokens to null (S4);
    ``keep_na_text=True`` keeps every cell as written, '' included (S4b).
    """
    reader = (spark.read.option("header", True).option("inferSchema", False)
              # never let the reader decide what is missing: both variants see
              # the raw text, '' included
              .option("nullValue", "\u0001").option("emptyValue", ""))
    df = reader.csv(path)
    if keep_na_text:
        return df
    tokens = list(na_tokens)
    return df.select(*[
        F.when(F.col(f"`{c}`").isin(tokens), F.lit(None).cast("string"))
         .otherwise(F.col(f"`{c}`")).alias(c)
        for c in df.columns
    ])


def read_matching_file(spark: SparkSession, directory: str, pattern: str,
                       keep_na_text: bool = False) -> DataFrame:
    """S3: the gradebook whose file name contains ``pattern``.

    Only the listing is read to choose it (paths, no content); the
    lexicographically first file name wins, so the choice is deterministic,
    and the chosen file is read alone, under its own header.  Returns the rows
    plus ``source_file``.
    """
    name = F.element_at(F.split("path", "/"), -1)
    found = (spark.read.format("binaryFile").option("pathGlobFilter", f"*{pattern}*").load(directory)
             .select("path").agg(F.min_by("path", F.struct(name, "path")).alias("path"), F.min(name).alias("name")).first())
    if found["path"] is None:
        raise ValueError(f"no file containing {pattern!r} under {directory}")
    return read_raw_gradebook(spark, found["path"], keep_na_text).withColumn("source_file", F.lit(found["name"]))


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                order_by: Iterable[str | Column] | None = None,
                partitions: int | None = None) -> str:
    """Overwrite-write a table (parquet or headed CSV).

    ``order_by`` sorts globally before writing (report files); ``partitions``
    only coalesces small results, never repartitions big ones.
    """
    if order_by:
        df = df.orderBy(*order_by)
    if partitions:
        df = df.coalesce(partitions)
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        (writer.option("header", True)
         # keep cell text exactly as it is (the writer trims by default)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(path))
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return path
