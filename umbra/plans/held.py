"""Intermediate rows that several jobs read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def folder(df: DataFrame) -> str | None:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, a single machine gets a
    temporary one, and a cluster, whose executors wouldn't find that, none."""
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="umbra-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def held(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that lineage ends there and a lost executor costs a reread; where there is
    none, df as it is, which each job computes anew.  The tables go with the folder."""
    to = folder(df)
    if not to:
        return df
    path = f"{to.rstrip('/')}/umbra-held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
