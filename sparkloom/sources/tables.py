"""Sources: Parquet tables, nested JSON catalogs, page files and submissions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_ranges import RANGE_BYTES, json_parts
from .listing import as_address, files_below, with_contents
from .session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; Spark prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_catalog(spark: SparkSession, path: str, schema: T.StructType | str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of a JSON document with a given schema, with ``pos`` for their order; a list of objects gives a row each.

    The document is read in byte ranges (see ``json_ranges.json_parts``), by as
    many tasks as it has ranges. A record of another type has nulls.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return json_parts(spark, path, range_bytes).select("pos", F.from_json("value", kind).alias("r")).select("pos", "r.*")


def page_files(spark: SparkSession, folder: str, suffix: str = ".html") -> DataFrame:
    """``path``, ``length`` and ``html`` of all files below a folder whose names end in the suffix; tasks list and read them."""
    files = files_below(spark, folder).where(F.col("path").endswith(suffix))
    return with_contents(files, folder).select(F.concat(F.lit(as_address(folder)), "path").alias("path"), "length", F.decode("content", "UTF-8").alias("html"))


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` and ``length`` of all files below a folder; tasks list them, their contents aren't read."""
    return files_below(spark, folder).select(F.concat(F.lit(as_address(folder)), "path").alias("path"), "length")


def keyed_state(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What ``sinks.write_state`` wrote, with the JSON read as a given schema."""
    rows = spark.read.parquet(folder)
    return rows.select(*(c for c in rows.columns if c not in ("state", "bucket")), F.from_json("state", schema).alias("s")).select("*", "s.*").drop("s")


def submissions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Submissions from lines of JSON; a line that can't be read comes with nulls and its text in ``_corrupt_record``."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: what follows more than once, or after a lost executor, sees the same rows."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
