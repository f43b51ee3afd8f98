"""Near copies among embeddings by an epsilon grid order join.

Unit vectors whose cosine is at least T lie at most epsilon = sqrt(2 - 2 T) apart.  Vectors are sorted
by the cells of a grid of that width on their leading principal dimensions and cut into blocks of
consecutive ones.  Intervals of the sequence are joined recursively: a pair of intervals whose boxes on
those dimensions (with the length of the rest as one more dimension) are provably more than epsilon
apart is skipped, all other pairs split until they are pairs of blocks; a task goes on with these, down
to pairs of LEAF vectors and with more dimensions.  What is left is compared in single precision first,
with a margin for its rounding, and decided in double precision.  So no pair is missed, whatever the
axes; they are fitted on a bounded sample and decide speed alone.  On vectors without structure in few
dimensions little can be skipped.

Equal vectors are joined once, as one, and counted.  A pair of blocks yields a count and a link to the
smallest member of its group in these blocks for each vector, never its pairs.

A vector that is null, empty, zero or holds a null or non-finite component links with nothing; so does
a row with a null id (component null, kept).  Vectors of different lengths don't link.  Repeated rows
count as other vectors; n_links is each row's own, but rows with one id are one node: what links with
one of its vectors is in one component with all of them.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, dropped, small_batches, stored

#: Least cosine; grid dimensions; vectors of a block; intervals under one; vectors that fit the axes, on average.
COSINE, DIMENSIONS, BLOCK, FAN, SAMPLE = 0.95, 8, 4096, 8, 4096
#: Vectors of the smallest interval within a task, dimensions of its box.
LEAF, FINE = 64, 24


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def axes(sample: np.ndarray, dimensions: int) -> np.ndarray:
    """Leading principal axes of unit vectors, as columns."""
    u = unit(sample)
    u = u - u.mean(axis=0)
    return np.linalg.eigh(u.T @ u)[1][:, ::-1][:, :dimensions]


def places(x: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """Coordinates on the axes and the length of what they leave; distances there are lower bounds."""
    u = unit(x)
    p = u @ axis
    return np.column_stack([p, np.sqrt(np.maximum(0, 1 - (p * p).sum(axis=1)))])


class _Groups:
    """Least labels of linked nodes, under links that come in bulk."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            differ = label[a] != label[b]
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label[label] != label).any():
                label[:] = label[label]


def _boxes(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest coordinates of each leaf."""
    at = np.arange(0, len(p), LEAF)
    return np.minimum.reduceat(p, at), np.maximum.reduceat(p, at)


def join_blocks(x: np.ndarray, y: np.ndarray | None, weight_x: np.ndarray, weight_y: np.ndarray, least: float, axis: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(links by node, label by node, pairs compared) over x's rows, then y's (none if y is None: x with itself)."""
    same = y is None
    u, p = unit(x), places(x, axis)
    v, q = (u, p) if same else (unit(y), places(y, axis))
    shift = 0 if same else len(u)
    n = len(u) + (0 if same else len(v))
    weight = weight_x if same else np.concatenate([weight_x, weight_y])
    links, groups, compared = np.zeros(n), _Groups(n), 0
    u4, v4 = u.astype(np.float32), v.astype(np.float32)
    rough = np.float32(least - 1e-6 - 2.4e-7 * u.shape[1])
    (lo, hi), (lo_y, hi_y) = _boxes(p), _boxes(q)
    for i in range(len(lo)):
        gap = np.maximum(0, np.maximum(lo[i] - hi_y, lo_y - hi[i]))
        near = (gap * gap).sum(axis=1) <= 2 - 2 * least + 1e-9
        if same:
            near[:i] = False
        if not near.any():
            continue
        at = i * LEAF
        rows = np.flatnonzero(np.repeat(near, LEAF)[: len(v)])
        compared += len(rows) * min(LEAF, len(u) - at)
        a, b = np.nonzero(u4[at : at + LEAF] @ v4[rows].T >= rough)
        a, b = a + at, rows[b]
        if same:
            above = a < b
            a, b = a[above], b[above]
        for k in range(0, len(a), 65536):  # bounds what is decided at once
            c, d = a[k : k + 65536], b[k : k + 65536]
            hit = (u[c] * v[d]).sum(axis=1) >= least
            c, d = c[hit], d[hit] + shift
            if len(c):
                links += np.bincount(c, weight[d], n) + np.bincount(d, weight[c], n)
                groups.link(c, d)
    return links.astype(np.int64), groups.label, compared


def _one_length(d: DataFrame, width: int, kind: str, least: float, block: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """(rep, n) and (u, v): links by other representatives, weighted, and links that connect, of vectors of one length."""
    spark = d.sparkSession
    eps2 = 2 - 2 * least
    n = d.count()
    drawn = d.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < min(1 << 30, math.ceil((sample << 30) / max(1, n)))).select("embedding").toArrow()
    fitted = drawn.column(0).combine_chunks() if drawn.num_rows else pa.array([], drawn.schema[0].type)
    k = min(DIMENSIONS, width)
    fine = axes(_matrix(fitted, width), min(FINE, width)) if drawn.num_rows > 1 else np.eye(width)[:, : min(FINE, width)]
    axis = fine[:, :k]
    cell = math.sqrt(eps2)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = places(_matrix(b.column(2), width), axis)[:, :k]
                cells = np.clip(np.floor((p + 1) / cell), 0, 65535).astype(">u2")
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x.tobytes() for x in cells], pa.binary())], names=["rep", "copies", "embedding", "cells"])

    ordered = d.mapInArrow(keyed, f"rep long, copies long, embedding {kind}, cells binary").repartitionByRange("cells", "rep").sortWithinPartitions("cells", "rep")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows))], names=["rep", "copies", "embedding", "part", "at"])
            at += b.num_rows

    sequence, sequence_path = stored(ordered.mapInArrow(numbered, f"rep long, copies long, embedding {kind}, part int, at long"), "sequence")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sequence.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row a partition
    in_block = sequence.join(base, "part").select("rep", "copies", "embedding", (F.col("base") + F.col("at")).alias("at")).withColumn("block", F.expr(f"at div {block}"))
    box = ", ".join(f"lo{i} double, hi{i} double" for i in range(k + 1))
    wide = np.dtype("<f8" if "double" in kind else "<f4")
    names = ["block", "ids", "copies", "vectors", *(f"{x}{i}" for i in range(k + 1) for x in ("lo", "hi"))]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(block_id: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            m = _matrix(t.column("embedding").combine_chunks(), width).astype(wide)
            p = places(m, axis)
            values = [pa.array([block_id], pa.int64()), *(pa.array([x], pa.binary()) for x in (t.column("rep").to_numpy().astype("<i8").tobytes(), t.column("copies").to_numpy().astype("<i8").tobytes(), m.tobytes()))]
            values += [pa.array([f], pa.float64()) for lo, hi in zip(p.min(axis=0), p.max(axis=0)) for f in (lo, hi)]
            return pa.RecordBatch.from_arrays(values, names=names)

        now, parts = None, []
        for b in batches:
            ids = b.column(3).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if ids[i] != now and parts:
                    yield row(now, parts)
                    parts = []
                now = int(ids[i])
                parts.append(b.slice(i, j - i))
        if parts:
            yield row(now, parts)

    blocks, blocks_path = stored(in_block.select("rep", "copies", "embedding", "block", "at").repartition("block").sortWithinPartitions("block", "at").mapInArrow(gathered, f"block long, ids binary, copies binary, vectors binary, {box}"), "blocks")
    dropped(spark, sequence_path)
    # intervals: level 0 are the blocks, FAN of a level are one of the next
    boxes = blocks.select("block", *(f"{x}{i}" for i in range(k + 1) for x in ("lo", "hi"))).withColumnRenamed("block", "at")
    levels, count = [boxes], -(-n // block)
    while count > 1:
        levels.append(levels[-1].groupBy(F.expr(f"at div {FAN}").alias("at")).agg(*(f(f"{x}{i}").alias(f"{x}{i}") for i in range(k + 1) for x, f in (("lo", F.min), ("hi", F.max)))))
        count = -(-count // FAN)
    gap = " + ".join(f"power(greatest(0D, a.lo{i} - b.hi{i}, b.lo{i} - a.hi{i}), 2)" for i in range(k + 1))
    pairs, pairs_path = stored(levels[-1].select(F.col("at").alias("x"), F.col("at").alias("y")), "pairs")
    for level in levels[-2::-1]:
        a = level.withColumn("up", F.expr(f"at div {FAN}")).alias("a")
        b = level.withColumn("up", F.expr(f"at div {FAN}")).alias("b")
        joined = pairs.join(a, F.expr("x = a.up")).join(b, F.expr("y = b.up")).where(f"a.at <= b.at and {gap} <= {eps2} + 1e-9")
        finer, path = stored(joined.select(F.col("a.at").alias("x"), F.col("b.at").alias("y")), "pairs")
        dropped(spark, pairs_path)
        pairs, pairs_path = finer, path

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                mx = np.frombuffer(r["vx"], wide).reshape(-1, width)
                ids, wx = np.frombuffer(r["ix"], "<i8"), np.frombuffer(r["cx"], "<i8")
                if r["x"] == r["y"]:
                    links, label, _ = join_blocks(mx, None, wx, wx, least, fine)
                else:
                    iy, wy = np.frombuffer(r["iy"], "<i8"), np.frombuffer(r["cy"], "<i8")
                    links, label, _ = join_blocks(mx, np.frombuffer(r["vy"], wide).reshape(-1, width), wx, wy, least, fine)
                    ids = np.concatenate([ids, iy])
                on = np.flatnonzero(links)
                if len(on):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(links[on]), pa.array(ids[label[on]])], names=["rep", "n", "root"])

    # a row is two blocks: few of them at once
    content = small_batches(blocks, blocks_path, 8).select("block", "ids", "copies", "vectors")
    tiles = small_batches(pairs, pairs_path, 8).join(content.toDF("x", "ix", "cx", "vx"), "x").join(content.toDF("y", "iy", "cy", "vy"), "y").select("x", "ix", "cx", "vx", "y", "iy", "cy", "vy")
    found, path = stored(tiles.mapInArrow(compared, "rep long, n long, root long"), "links")
    found = spark.read.schema(found.schema).parquet(path)
    dropped(spark, pairs_path, blocks_path)
    return found.groupBy("rep").agg(F.sum("n").alias("n")), found.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v"))


def near_copies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = COSINE, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row: other rows linked directly, the smallest id
    that links reach, and whether that is its own."""
    kind = "array<double>" if "double" in vectors.schema[vector_col].dataType.simpleString() else "array<float>"
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("embedding"))
    right = "id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    spark = d.sparkSession
    # nodes are numbered, as ids may repeat with other vectors; the numbers are final once the table is written
    reps = d.where(right).groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    reps, reps_path = stored(reps.select(F.monotonically_increasing_id().alias("rep"), "id", "copies", "embedding"), "vectors")
    counts = spark.createDataFrame([], "rep long, n long")
    edges = spark.createDataFrame([], "u long, v long")
    for (width,) in reps.select(F.size("embedding").alias("w")).distinct().orderBy("w").collect():
        n, e = _one_length(reps.where(F.size("embedding") == width).select("rep", "copies", "embedding"), width, kind, least, block, sample)
        counts, edges = counts.unionByName(n), edges.unionByName(e)
    several = d.where(right).groupBy("id").agg(F.min(F.xxhash64("embedding")).alias("x"), F.max(F.xxhash64("embedding")).alias("y")).where("x <> y").select("id")
    several, several_path = stored(d.where(right).join(several, "id").distinct().join(reps.select("embedding", "rep"), "embedding").select("id", "rep"), "ids")
    same_id = several.groupBy("id").agg(F.min("rep").alias("u")).join(several, "id").select("u", F.col("rep").alias("v"))
    member = components(edges.union(same_id)).withColumnRenamed("node", "rep")
    per_rep = reps.join(counts.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left").join(member, "rep", "left")
    named, named_path = stored(per_rep.select("embedding", "id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c")), "named")
    smallest, smallest_path = stored(named.groupBy("c").agg(F.min("id").alias("component_id")), "least")
    by_vector, _ = stored(named.join(smallest, "c").select("embedding", "n_links", "component_id"), "by-vector")
    dropped(spark, reps_path, several_path, named_path, smallest_path)
    good = d.where(right).join(by_vector, "embedding").select("id", "n_links", "component_id")
    # a row without a vector goes with the other vectors of its id, if there are any
    rest = d.where(f"not coalesce({right}, false)").select("id")
    kin = good.join(rest.where("id is not null").distinct(), "id", "left_semi").groupBy("id").agg(F.min("component_id").alias("component_id"))
    rest = rest.join(kin, "id", "left").select("id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return good.union(rest).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id").isNull() | F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"))
