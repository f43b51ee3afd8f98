"""Strict CSV tables as DataFrames of strings."""

from __future__ import annotations

import csv
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..errors import Refused


def read_csv(spark: SparkSession, path: str, allow_empty: bool = False) -> DataFrame:
    """The file's records, all columns strings, empty cells empty strings.

    Spark renames repeated headers and turns empty cells to NULL; so the header is read as text and
    checked, and NULLs are filled.  A record of another width fails the read."""
    first = spark.read.text(path).limit(1).collect()
    header = next(csv.reader([first[0][0].removeprefix("﻿")]), []) if first else []
    if not header or len(set(header)) < len(header) or any(not h for h in header):
        raise Refused("csv-header")
    schema = StructType([StructField(h, StringType()) for h in header])
    df = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", multiLine=True, quote='"', escape='"', enforceSchema=False).na.fill("")
    if not allow_empty and df.limit(1).count() == 0:
        raise Refused("csv-empty")
    return df


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 and bytes of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def committed(df: DataFrame, path: str, check: Callable[[DataFrame | None], None]) -> None:
    """df as CSV at a path that must not exist: written beside it, read back (None if it has no rows) and given to check(); renamed to
    its place if that doesn't raise, else deleted."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(conf)
    if fs.exists(to):
        raise Refused("output-exists")
    beside = f"{path.rstrip('/')}.umbra-{uuid.uuid4().hex}"
    at = jvm.org.apache.hadoop.fs.Path(beside)
    try:
        df.write.mode("errorifexists").csv(beside, header=True, quote='"', escape='"')
        kept = spark.read.csv(beside, schema=", ".join(f"`{c}` string" for c in df.columns), header=True, multiLine=True, quote='"', escape='"').na.fill("")
        check(None if kept.isEmpty() else kept)
        if fs.exists(to) or not fs.rename(at, to):
            raise Refused("output-exists")
    finally:
        if fs.exists(at):
            fs.delete(at, True)
