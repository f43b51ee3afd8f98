"""What the operators share: tables in the cluster's shared folder, connected components, batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a single machine (tests) gets a temporary one; a cluster is refused, as its
    executors would not find a folder of the driver's."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="umbra-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Paths written within each open scratch(), innermost last.
_SCOPES: list[list[str]] = []


def stored(df: DataFrame, name: str, keep: bool = False) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read again: lineage ends there, and a lost
    executor costs a reread, not a recomputation.  keep: beyond the end of the scratch() around it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/umbra-{name}-{uuid.uuid4().hex}"
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all tables that were stored within: their readers must be done by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        dropped(spark, *_SCOPES.pop())


def small_batches(df: DataFrame, path: str, rows: int) -> DataFrame:
    """The table at path, of df's columns, in a session of its own, whose plans hand Python at most so many
    rows at once: for rows of large values.  Other queries of df's session keep their setting."""
    spark = df.sparkSession
    key = f"umbra-small-batches-{rows}"
    own = _SESSIONS.get((spark, key))
    if own is None:
        own = _SESSIONS[spark, key] = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if own.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return own.read.schema(df.schema).parquet(path)


_SESSIONS: dict = {}


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: The module whose functions this worker ran last.
_RAN: list[str] = []


def _alone(module: str) -> None:
    """A worker lives on from stage to stage: what another module keeps in it (forget() of that module) goes, back to the system too."""
    if _RAN and _RAN[0] != module:
        forget = getattr(sys.modules.get(_RAN[0]), "forget", None)
        if forget:
            forget()
            gc.collect()
            with suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)
    _RAN[:] = [module]


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """df through f, batch by batch; f returns columns by name (or None for no rows)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out, module = to_arrow_schema(StructType.fromDDL(schema)), f.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _alone(module)
        for batch in batches:
            if batch.num_rows and (got := f(batch)) is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for t, x in ((t, got[t.name]) for t in out)], schema=out)

    return df.mapInArrow(run, schema)


def _unsettled(links: DataFrame) -> bool:
    """Whether a node is at both ends of links, or at the larger end of links to several."""
    ends = links.select(F.col("u").alias("x"), "v").union(links.select("v", F.lit(None).cast("long")))
    seen = ends.groupBy("x").agg(F.count("*").alias("n"), F.count("v").alias("larger"), F.min("v").alias("a"), F.max("v").alias("b"))
    return not seen.where("larger > 0 and (n > larger or a < b)").isEmpty()


#: Links that a task joins at once before the rounds.
CHUNK = 1 << 20


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) chunk by chunk as links (node, least node that the chunk's links reach)."""

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        label = np.arange(len(nodes))
        while len(a):
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label[label] != label).any():
                label = label[label]
            differ = label[a] != label[b]
            a, b = a[differ], b[differ]
        on = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(nodes[label[on]])], names=["u", "v"])

    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= CHUNK:
            yield one(held)
            held, size = [], 0
    if held:
        yield one(held)


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component): each node of an edge with the smallest node that it reaches.

    First each task replaces the links that it reads, chunk by chunk, by those to the least node they
    reach.  Then large-star and small-star steps alternate, each a minimum by node (combined before the
    shuffle) and an equi-join of two stored tables, whose skewed keys Spark can split, until each node
    has one link, to a node that has none to smaller ones.  Rounds grow with the logarithm of the longest
    path; only whether they are done reaches the driver.
    """
    spark = edges.sparkSession
    links = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e, path = stored(links.mapInArrow(_united, "u long, v long"), "edges")
    while _unsettled(e):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, low_path = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large, large_path = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low2, low2_path = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        linked = large.join(low2, "u")
        small = linked.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e, new_path = stored(small, "edges")
        dropped(spark, path, low_path, large_path, low2_path)
        path = new_path
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
