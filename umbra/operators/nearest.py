"""Nearest rows by mean distance over numbers (share of the span) and nominal columns (0 or 1), by space partition.

A k-d tree over a bounded sample cuts the space into cells: a number at the sample's median, a nominal column into two
sets of values (unseen values go to the second).  A cell's box is what its path allows of nominal values and the least
and largest of its rows' numbers.  First each point is held against one block of its own cell, which bounds its
distance; then against the cells whose box isn't farther than that.  Cells of many rows are cut into blocks, points
of a frequented cell into slices, so a task holds BLOCK rows and a batch of points.  The nearest rows are all within
1e-9 of the least distance, relative to the larger one, as a tie.

What reaches the driver: SAMPLE rows, and per cell two numbers a numeric column and two counts.  How many cells a
point visits depends on the data: with many unrelated nominal columns all cells may be about as near.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..plans.held import held

_KINDS = {"d": DoubleType(), "bound": DoubleType(), "cell": IntegerType(), "block": IntegerType()}
#: Rows that the tree is built from, rows of them to a cell, cells at most, rows of a block, points of a slice, relative tolerance.
SAMPLE, EACH, CELLS, BLOCK, SLICE, CLOSE = 65_536, 32, 4096, 8192, 65_536, 1e-9


class Cells:
    """The tree: nodes (column, cut, left, right), a negative child -1 - i being cell i; numbers come first among columns."""

    def __init__(self, xs: np.ndarray, cs: list[list[str | None]], spans: Sequence[float], cells: int):
        self.spans = spans
        self.nodes: list[tuple] = []
        self.n = 0
        n_x = xs.shape[1]
        cells = max(1, min(cells, len(cs) // 2))
        todo: list[tuple] = [(np.arange(len(cs)), None, 0)]  # rows, parent, side
        depth_most = max(1, int(np.ceil(np.log2(cells)))) if cells > 1 else 0
        self.root = -1

        def attach(parent: int | None, side: int, what: int) -> None:
            if parent is None:
                self.root = what
            else:
                self.nodes[parent][2 + side] = what

        level = 0
        while todo:
            after = []
            for rows, parent, side in todo:
                cut = self._cut(rows, xs, cs, n_x) if level < depth_most and len(rows) > 1 else None
                if cut is None:
                    attach(parent, side, -1 - self.n)
                    self.n += 1
                    continue
                column, at, left = cut
                attach(parent, side, len(self.nodes))
                self.nodes.append([column, at, 0, 0])
                me = len(self.nodes) - 1
                for s, part in enumerate((rows[left], rows[~left])):
                    after.append((part, me, s))
            todo, level = after, level + 1

    def _cut(self, rows: np.ndarray, xs: np.ndarray, cs: list, n_x: int) -> tuple | None:
        """The column of the largest spread, where to cut it, and which rows are left of the cut."""
        best: tuple = (0.0, None)
        for i in range(n_x):
            v = xs[rows, i]
            spread = (np.quantile(v, 0.95) - np.quantile(v, 0.05)) / self.spans[i] if self.spans[i] > 0 else 0
            if spread > best[0]:
                best = (spread, i)
        values: dict[int, dict] = {}
        for j in range(len(cs[0])):
            count: dict[str | None, int] = {}
            for r in rows:
                count[cs[r][j]] = count.get(cs[r][j], 0) + 1
            values[j] = count
            top = max(count.values())
            # the chance that two rows differ in the column
            spread = 1 - sum(n * n for n in count.values()) / len(rows) ** 2
            if top < len(rows) and spread > best[0]:
                best = (spread, n_x + j)
        column = best[1]
        if column is None:
            return None
        if column < n_x:
            v = xs[rows, column]
            at = float(np.median(v))
            left = v < at
            if not left.any():
                left = v <= at
                at = float(np.nextafter(at, np.inf))
            if left.all():
                return None
            return column, at, left
        count = values[column - n_x]
        chosen, n = set(), 0
        for v in sorted(count, key=lambda v: (-count[v], v is None, v or "")):
            if n + count[v] <= len(rows) / 2 or not chosen:
                chosen.add(v)
                n += count[v]
        left = np.array([cs[r][column - n_x] in chosen for r in rows])
        return None if left.all() else (column, frozenset(chosen), left)

    def cell(self, x: np.ndarray, c: list[list[str | None]]) -> np.ndarray:
        """The cell of each row."""
        out = np.empty(len(c), np.int32)
        todo = [(self.root, np.arange(len(c)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out[rows] = -1 - node
                continue
            column, at, left, right = self.nodes[node]
            if column < x.shape[1]:
                to = x[rows, column] < at
            else:
                to = np.fromiter((c[r][column - x.shape[1]] in at for r in rows), bool, len(rows))
            todo += [(left, rows[to]), (right, rows[~to])]
        return out

    def bounds(self, x: np.ndarray, c: list[list[str | None]], low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Points x cells: a distance that no row of the cell is below (before the division by columns)."""
        out = np.zeros((len(c), self.n))
        for i, span in enumerate(self.spans):
            if span > 0:
                out += np.maximum(0, np.maximum(low[None, :, i] - x[:, i, None], x[:, i, None] - high[None, :, i])) / span
        if not c or not c[0]:
            return out
        kinds = [list(dict.fromkeys(r[j] for r in c)) for j in range(len(c[0]))]
        places = [np.fromiter((place[r[j]] for r in c), np.int64, len(c)) for j, k in enumerate(kinds) for place in [{v: i for i, v in enumerate(k)}]]
        # down the tree: in how many nominal columns a point can't agree with what is below, and which these are
        todo = [(self.root, np.zeros(len(c)), {})]
        while todo:
            node, n, differs = todo.pop()
            if node < 0:
                out[:, -1 - node] += n
                continue
            column, at, *children = self.nodes[node]
            j = column - x.shape[1]
            if j < 0:
                todo += [(child, n, differs) for child in children]
                continue
            unknown = np.fromiter((v is None for v in kinds[j]), bool, len(kinds[j]))
            inside = np.fromiter((v in at for v in kinds[j]), bool, len(kinds[j]))
            for child, apart in zip(children, (~inside | unknown, inside | unknown)):
                now = apart[places[j]]
                old = differs.get(j)
                todo.append((child, n + (now if old is None else now & ~old), differs | {j: now if old is None else now | old}))
        return out


def _columns(df: DataFrame, numeric: Sequence[str], nominal: Sequence[str]) -> tuple[Column, Column]:
    xs = F.array(*[F.col(f"`{c}`").cast("double") for c in numeric]) if numeric else F.expr("cast(array() as array<double>)")
    cs = F.array(*[F.col(f"`{c}`").cast("string") for c in nominal]) if nominal else F.expr("cast(array() as array<string>)")
    return xs.alias("xs"), cs.alias("cs")


_KNOWN = "not exists(xs, x -> x is null or isnan(x))"


def _arrays(b: pa.RecordBatch, n_x: int) -> tuple[np.ndarray, list[list[str | None]]]:
    x = np.array(b.column("xs").to_pylist(), float).reshape(b.num_rows, n_x)
    return x, b.column("cs").to_pylist()


def nearest(release: DataFrame, points: DataFrame, numeric: Sequence[str], nominal: Sequence[str], low: str, high: str, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """For each distinct tuple of `points`, pid: struct of the columns, over all nearest rows of `release`: umbra_lo (least `low`),
    umbra_hi (largest `high`), umbra_rows (how many).

    Released rows with a null or NaN in a numeric column are nobody's neighbours, and points with one have none (no row);
    a null nominal value differs from every value.  An empty release gives no rows.  Nominal columns are compared as text."""
    if not numeric and not nominal:
        raise ValueError("no columns to compare by")
    spark, q, n_x = release.sparkSession, [*numeric, *nominal], len(numeric)
    labels = [F.col(f"`{low}`").alias("umbra_a"), F.col(f"`{high}`").alias("umbra_b")]
    rows = release.select(*_columns(release, numeric, nominal), *labels).where(_KNOWN)
    rows = rows.groupBy("xs", "cs").agg(F.min("umbra_a").alias("lo"), F.max("umbra_b").alias("hi"), F.count("*").alias("n"))
    asked = points.select(F.struct(*[F.col(f"`{c}`") for c in q]).alias("pid"), *_columns(points, numeric, nominal)).where(_KNOWN).distinct()
    kinds = {f.name: f.dataType for f in (*rows.schema.fields, *asked.schema.fields)}
    schema = lambda *names: StructType([StructField(n, k if (k := kinds.get(n)) is not None else _KINDS[n]) for n in names])
    null = lambda n: F.lit(None).cast(kinds.get(n) or _KINDS[n]).alias(n)

    spans: list[float] = []
    if numeric:
        both = release.select(*[F.col(f"`{c}`").cast("double") for c in numeric]).toDF(*[f"x{i}" for i in range(n_x)]).union(points.select(*[F.col(f"`{c}`").cast("double") for c in numeric]))
        both = both.select(*[F.expr(f"nanvl(x{i}, null)").alias(f"x{i}") for i in range(n_x)])
        spans = [x or 0.0 for x in both.agg(*[(F.max(f"x{i}") - F.min(f"x{i}")).alias(f"x{i}") for i in range(n_x)]).first()]
    taken = rows.select("xs", "cs").orderBy(F.xxhash64("xs", "cs")).limit(sample).toArrow()
    held_x = np.array(taken.column("xs").to_pylist(), float).reshape(taken.num_rows, n_x)
    held_c = taken.column("cs").to_pylist()
    if not taken.num_rows:
        return asked.limit(0).select("pid", null("lo").alias("umbra_lo"), null("hi").alias("umbra_hi"), F.lit(0).cast("long").alias("umbra_rows"))
    tree = Cells(held_x, held_c, spans, min(CELLS, max(1, taken.num_rows // EACH)))

    def in_cells(df: DataFrame) -> DataFrame:
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.cell(*_arrays(b, n_x)), pa.int32())], names=[*b.schema.names, "cell"])

        return df.mapInArrow(f, StructType([*df.schema.fields, StructField("cell", IntegerType())]))

    rows, asked = in_cells(rows), in_cells(asked)
    stats = rows.groupBy("cell").agg(F.count("*").alias("n"), *[F.min(F.col("xs")[i]).alias(f"a{i}") for i in range(n_x)], *[F.max(F.col("xs")[i]).alias(f"b{i}") for i in range(n_x)]).collect()
    least, most, blocks = np.full((tree.n, n_x), np.inf), np.full((tree.n, n_x), -np.inf), np.ones(tree.n, np.int32)
    live = np.zeros(tree.n, bool)
    for s in stats:
        least[s["cell"]], most[s["cell"]] = [s[f"a{i}"] for i in range(n_x)], [s[f"b{i}"] for i in range(n_x)]
        blocks[s["cell"]], live[s["cell"]] = -(-s["n"] // block), True
    block_of = F.element_at(F.array(*[F.lit(int(n)) for n in blocks]), F.col("cell") + 1) if tree.n <= 64 else None
    sizes = spark.createDataFrame([(i, int(n)) for i, n in enumerate(blocks)], "cell int, blocks int")
    with_blocks = (lambda d: d.withColumn("blocks", block_of)) if block_of is not None else (lambda d: d.join(F.broadcast(sizes), "cell"))  # CELLS rows at most
    rows = with_blocks(rows).withColumn("block", F.expr("pmod(xxhash64(xs, cs), blocks)").cast("int")).drop("blocks")

    def compared(visits: DataFrame) -> DataFrame:
        """visits (pid, xs, cs, bound, cell, block) against the rows of each block; ties of each block apart by distance."""
        busy = {(r["cell"], r["block"]): -(-r["m"] // SLICE) for r in visits.groupBy("cell", "block").agg(F.count("*").alias("m")).where(f"m > {SLICE}").collect()}
        v = visits.withColumn("slice", F.lit(0))
        r = rows.withColumn("slice", F.lit(0))
        if busy:  # as many as there are cells and blocks of many points
            many = spark.createDataFrame([(*k, n) for k, n in busy.items()], "cell int, block int, slices int")
            v = visits.join(many, ["cell", "block"], "left").withColumn("slice", F.expr("pmod(xxhash64(pid), coalesce(slices, 1))").cast("int")).drop("slices")
            r = rows.join(many, ["cell", "block"], "left").withColumn("slice", F.explode(F.expr("sequence(0, coalesce(slices, 1) - 1)"))).drop("slices")
        where = ["cell", "block", "slice"]
        r = r.select(*where, F.lit(0).alias("side"), "xs", "cs", null("pid"), null("bound"), "lo", "hi", "n")
        v = v.select(*where, F.lit(1).alias("side"), "xs", "cs", "pid", "bound", null("lo"), null("hi"), null("n"))
        stream = r.union(v).repartition(*where).sortWithinPartitions(*where, "side")
        return stream.mapInArrow(lambda batches: _compared(batches, tree, n_x, len(q)), schema("pid", "d", "lo", "hi", "n"))

    visits = schema("pid", "xs", "cs", "bound", "cell", "block")

    def visit(first: DataFrame | None) -> DataFrame:
        if first is None:
            def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                """The nearest cell by its box that holds rows, one block of it."""
                for b in batches:
                    x, c = _arrays(b, n_x)
                    low = np.where(live[None, :], tree.bounds(x, c, least, most), np.inf)
                    at = b.column("cell").to_numpy()
                    cell = np.where(live[at], at, low.argmin(axis=1)).astype(np.int32)
                    piece = np.arange(b.num_rows) % blocks[cell]
                    yield pa.RecordBatch.from_arrays([b.column("pid"), b.column("xs"), b.column("cs"), pa.nulls(b.num_rows, pa.float64()), pa.array(cell), pa.array(piece.astype(np.int32))], names=["pid", "xs", "cs", "bound", "cell", "block"])

            return asked.mapInArrow(own, visits)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 512):
                    b = whole.slice(start, 512)
                    x, c = _arrays(b, n_x)
                    low = np.where(live[None, :], tree.bounds(x, c, least, most), np.inf) / len(q)
                    bound = b.column("bound").to_numpy()
                    p, k = np.nonzero(low <= (bound * (1 + 1e-6) + 1e-12)[:, None])
                    times = blocks[k]
                    p, k = np.repeat(p, times), np.repeat(k, times)
                    piece = np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)
                    take = pa.array(p)
                    yield pa.RecordBatch.from_arrays([b.column(n).take(take) for n in ("pid", "xs", "cs", "bound")] + [pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32))], names=["pid", "xs", "cs", "bound", "cell", "block"])

        return first.mapInArrow(near, visits)

    upper = compared(visit(None)).groupBy("pid").agg(F.min("d").alias("bound"))
    first = asked.select("pid", "xs", "cs").join(upper.withColumnRenamed("pid", "pid2"), F.expr("pid <=> pid2")).select("pid", "xs", "cs", "bound")
    found = compared(visit(held(first)))
    least_d = F.expr("min(d) over (partition by pid)")
    found = found.withColumn("umbra_least", least_d).where(f"d - umbra_least <= {CLOSE!r}D * d")
    return found.groupBy("pid").agg(F.min("lo").alias("umbra_lo"), F.max("hi").alias("umbra_hi"), F.sum("n").alias("umbra_rows"))


def _compared(batches: Iterator[pa.RecordBatch], tree: Cells, n_x: int, columns: int) -> Iterator[pa.RecordBatch]:
    """A stream sorted by cell, block, slice and side: rows are held, points compared with them as they come."""
    at, held, codes = None, [], []
    ready = None
    names = ["pid", "d", "lo", "hi", "n"]

    def index() -> tuple:
        b = pa.Table.from_batches(held).combine_chunks()
        x = np.array(b.column("xs").to_pylist(), float).reshape(b.num_rows, n_x)
        c = b.column("cs").to_pylist()
        n_c = len(c[0])
        books: list[dict] = [{} for _ in range(n_c)]
        code = np.empty((len(c), n_c), np.int64)
        for i, r in enumerate(c):
            for j, v in enumerate(r):
                code[i, j] = -1 if v is None else books[j].setdefault(v, len(books[j]))
        return b, x, code, books

    for whole in batches:
        keys = np.stack([whole.column(n).to_numpy() for n in ("cell", "block", "slice", "side")], axis=1)
        change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for start, end in zip([0, *change], [*change, whole.num_rows]):
            if start == end:
                continue
            b, key, side = whole.slice(start, end - start), tuple(keys[start, :3]), keys[start, 3]
            if key != at:
                at, held, ready = key, [], None
            if side == 0:
                held.append(b)
                continue
            if not held:
                continue
            if ready is None:
                ready = index()
            table, x, code, books = ready
            step = max(1, 4_000_000 // len(x))
            for s in range(0, b.num_rows, step):
                part = b.slice(s, step)
                px, pc = _arrays(part, n_x)
                d = np.zeros((part.num_rows, len(x)))
                for i, span in enumerate(tree.spans):
                    if span > 0:
                        d += np.abs(px[:, i, None] - x[None, :, i]) / span
                for j in range(len(books)):
                    mine = np.fromiter((-2 if r[j] is None else books[j].get(r[j], -2) for r in pc), np.int64, len(pc))
                    d += mine[:, None] != code[None, :, j]
                d /= columns
                low = d.min(axis=1)
                bound = part.column("bound").to_numpy(zero_copy_only=False)
                good = (d * (1 - CLOSE) <= low[:, None]) & ~(low * (1 - 2 * CLOSE) > bound)[:, None]
                p, r = np.nonzero(good)
                if len(p):
                    got = pa.table({"pid": part.column("pid").take(pa.array(p)), "d": pa.array(d[p, r]), **{n: table.column(n).take(pa.array(r)) for n in ("lo", "hi", "n")}})
                    yield from got.combine_chunks().to_batches()
