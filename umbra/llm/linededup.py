"""Line dedup by a log-template tree.

A line's tokens are what blanks separate; a token with a digit is a variable field, `<*>`.  The tree
has a fixed depth: token count, then the leading tokens.  A leaf holds templates, each led by a line: in the order of
the smallest document that holds them, lines join the first leader that they agree with in at least SIMILARITY of their
positions, the other tokens being variable fields, or else lead a template of their own.  The order is that of
documents, not of arrival, so the outcome depends on neither partitions nor retries.  A template that recurs
across documents is kept in the document of the smallest id, which holds its leader, and dropped from all others.

Lines of under LEAST tokens, which a line without blanks is too, are their own leaves, unmasked: of a line of digits or one
without blanks a mask would leave nothing to tell it by.  They are dropped where the exact trimmed line recurs.
Lines of nothing but blanks stay.

Only leaves that hold several different lines of several documents are looked at closely; the rest
moves as hashes.  A leaf of more than CROWD different lines has the same templates as if one task saw it: its first
CROWD lines name their leaders, all others are held against these in stretches of CROWD lines, each a task's, and what joins
none of them is the leaf of the next round.

A null text stays null; empty texts and empty lines stay.  Rows of one id are one document (what one
repeats of another isn't dropped); a row with a null id is left as it is.  Lines of one first document go by
their text.  An empty table gives no rows; other columns are kept by clean().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, fresh, stored

#: Leading tokens of a leaf, tokens that a generalised line has at least, share of agreeing positions, different lines of a leaf in a task.
DEPTH, LEAST, SIMILARITY, CROWD = 4, 5, 0.7, 16_384
#: Leaves are first told by so many values of their hash, which any machine can hold.
MARKS = 1 << 20


def masked(line: Column) -> Column:
    """The line with `<*>` for each token that holds a digit."""
    line = F.trim(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(line)


def _lines(docs: DataFrame, least: int, depth: int) -> DataFrame:
    """(doc_id, th, line_no, masked, tokens, leaf) of lines that may be templates; a short line is its own leaf."""
    d = docs.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where("doc_id is not null")
    d = d.withColumn("tokens", F.length(F.trim("line")) - F.length(F.replace(F.trim("line"), F.lit(" "))) + 1)
    few = F.col("tokens") < least
    d = d.where(~few | F.col("line").rlike(r"[^ \t\x0B\f\r]"))
    d = d.select("doc_id", "th", "line_no", "tokens", F.when(few, F.trim("line")).otherwise(masked(F.col("line"))).alias("masked"))
    return d.withColumn("leaf", F.xxhash64("tokens", F.when(few, F.col("masked")).otherwise(F.substring_index("masked", " ", depth))))


def _words(lines: list[str], known: dict[str, int]) -> np.ndarray:
    """Lines of equally many tokens as rows of their tokens' numbers."""
    return np.array([[known.setdefault(w, len(known)) for w in x.split(" ")] for x in lines], np.int32)


def _leaders(ids: np.ndarray, similarity: float) -> np.ndarray:
    """Of each line the place of its leader."""
    need = similarity * ids.shape[1]
    leader = np.full(len(ids), -1)
    rest = np.arange(len(ids))
    while len(rest):
        joins = (ids == ids[0]).sum(axis=1) >= need
        leader[rest[joins]] = rest[0]
        rest, ids = (rest[1:], ids[1:]) if joins.sum() == 1 else (rest[~joins], ids[~joins])
    return leader


def _first_agreeing(ids: np.ndarray, leaders: np.ndarray, similarity: float) -> np.ndarray:
    """Of each line the place of the first leader that it agrees with, or -1."""
    need, out = similarity * ids.shape[1], np.full(len(ids), -1)
    alike = (ids == leaders[0]).all(axis=0) & (leaders == leaders[0]).all(axis=0)
    columns, kind = np.flatnonzero(~alike), np.uint8 if ids.shape[1] < 256 else np.int32
    turned = np.ascontiguousarray(leaders.T)
    for at in range(0, len(ids), 64):
        some = ids[at : at + 64]
        agree = np.full((len(some), len(leaders)), alike.sum(), kind)
        for c in columns:
            agree += some[:, c, None] == turned[c]
        joins = agree >= need
        out[at : at + 64] = np.where(joins.any(axis=1), joins.argmax(axis=1), -1)
    return out


def _by(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Consecutive rows that agree in their first columns."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list = []
    for some in rows:
        held += some
        if len(held) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held), schema)], schema=schema)


_PAIRS = pa.schema([("h", pa.int64()), ("leader", pa.int64())])
_LINES = pa.schema([("leaf", pa.int64()), ("first", pa.int64()), ("masked", pa.string()), ("h", pa.int64())])


def _led(similarity: float):
    """(h, leader) of lines (leaf, masked, h) sorted by leaf, first document and text: those of templates with several lines."""

    def leaf(rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        leader = _leaders(_words([x[1] for x in rows], {}), similarity)
        many = np.bincount(leader, minlength=len(rows))[leader] > 1
        return [(rows[i][2], rows[leader[i]][2]) for i in np.flatnonzero(many)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(map(leaf, _by(batches, 1)), _PAIRS)

    return run


def _stretches(size: int):
    """Sorted lines (leaf, first, masked, h) with the number of their stretch, which ascends in a leaf: at most size lines of it in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, base = None, 0, TaskContext.get().partitionId() << 32
        for b in batches:
            out = []
            for leaf in b.column(0).to_pylist():
                at, n = leaf, n + 1 if leaf == at else 0
                out.append(base + n // size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], schema=_LINES.append(pa.field("stretch", pa.int64())))

    return run


def _heads(similarity: float):
    """Sorted lines (leaf, first, masked, h) with their leader's h."""

    def leaf(rows: list[tuple]) -> list[tuple]:
        leader = _leaders(_words([x[2] for x in rows], {}), similarity)
        return [(*row, rows[i][3]) for row, i in zip(rows, leader)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(map(leaf, _by(batches, 1)), _LINES.append(pa.field("leader", pa.int64())))

    return run


def _followers(similarity: float):
    """Lines (leaf, stretch, whether it follows, first, masked, h) sorted so, leaders before lines that follow: these with their leader's h, or none."""

    def stretch(rows: list[tuple]) -> list[tuple]:
        k = sum(not x[2] for x in rows)
        known: dict[str, int] = {}
        leaders, ids = (_words([x[4] for x in part], known) for part in (rows[:k], rows[k:]))
        to = _first_agreeing(ids, leaders, similarity)
        return [(x[0], *x[3:], rows[i][5] if i >= 0 else None) for x, i in zip(rows[k:], to.tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(map(stretch, _by(batches, 2)), _LINES.append(pa.field("leader", pa.int64())))

    return run


def _crowded(rest: DataFrame, similarity: float, size: int) -> DataFrame:
    """(h, leader) of lines (leaf, first, masked, h) of leaves of any size: a task sees at most size lines and as many leaders."""
    spark, order, schema = rest.sparkSession, ("leaf", "first", "masked"), "leaf long, first long, masked string, h long"
    found, rest_path, tasks = [], None, int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        cut = rest.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stretches(size), schema + ", stretch long")
        cut, cut_path = stored(cut, "stretches")
        head = F.broadcast(cut.groupBy("leaf").agg(F.min("stretch").alias("head")))  # a row a leaf of more than size lines
        cut = cut.join(head, "leaf")
        heads = cut.where("stretch = head").select(*order, "h").repartition("leaf").sortWithinPartitions(*order)
        heads, _ = stored(heads.mapInArrow(_heads(similarity), schema + ", leader long"), "heads")
        found.append(heads.select("h", "leader"))
        if rest_path:
            dropped(spark, rest_path)
        later = cut.where("stretch > head")
        if later.isEmpty():
            break
        leaders = heads.where("h = leader").join(F.broadcast(later.select("leaf", "stretch").distinct()), "leaf")
        met = leaders.withColumn("follows", F.lit(False)).unionByName(later.drop("head").withColumn("follows", F.lit(True)), allowMissingColumns=True)
        met = met.select("leaf", "stretch", "follows", "first", "masked", "h").repartition(tasks, "leaf", "stretch").sortWithinPartitions("leaf", "stretch", "follows", "first", "masked")
        met, rest_path = stored(met.mapInArrow(_followers(similarity), schema + ", leader long"), "followers")
        joined, _ = stored(met.where("leader is not null").select("h", "leader"), "members")
        found.append(joined)
        rest = met.where("leader is null").drop("leader")
        dropped(spark, cut_path)
    return reduce(DataFrame.union, found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least: int = LEAST, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """(doc_id, th, drop array<int>): by document, and hash of its text, the lines to drop, if any."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    light, light_path = stored(_lines(d, least, depth).select("doc_id", "th", "line_no", "leaf", F.xxhash64("masked").alias("h")), "lines")
    leaves = light.groupBy("leaf").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("h").alias("x"), F.max("h").alias("y"))
    varied, varied_path = stored(leaves.where("a < b and x < y").select("leaf"), "leaves")
    # at most MARKS rows are broadcast; lines of other leaves don't move
    marks = F.broadcast(varied.select(F.expr(f"leaf & {MARKS - 1}").alias("mark")).distinct())
    lines = _lines(d, least, depth).where(F.col("tokens") >= least).withColumn("mark", F.expr(f"leaf & {MARKS - 1}")).join(marks, "mark", "left_semi")
    lines = lines.groupBy("leaf", "masked").agg(F.min("doc_id").alias("first")).join(varied, "leaf", "left_semi")
    lines, lines_path = stored(lines, "varied")
    crowded = F.broadcast(lines.groupBy("leaf").agg(F.count("*").alias("n")).where(f"n > {crowd}").select("leaf"))
    sorted_ = lines.join(crowded, "leaf", "left_anti").select("leaf", "masked", F.xxhash64("masked").alias("h"), "first").repartition("leaf").sortWithinPartitions("leaf", "first", "masked")
    to, to_path = stored(sorted_.mapInArrow(_led(similarity), "h long, leader long"), "members")
    more = lines.join(crowded, "leaf", "left_semi").select("leaf", "first", "masked", F.xxhash64("masked").alias("h"))
    if not more.isEmpty():
        to = to.union(_crowded(more, similarity, crowd))
    dropped(spark, lines_path, varied_path)
    # of each line its template, led by a line; of those that several documents hold, the first document
    seen = light.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    seen, seen_path = stored(seen.join(to, "h", "left").withColumn("t", F.coalesce("leader", "h")).where("a < b or leader is not null").select("h", "t", "a", "b"), "seen")
    first = seen.groupBy("t").agg(F.min("a").alias("first"), F.max("b").alias("last")).where("first < last").select("t", "first")
    recurring, recurring_path = stored(seen.join(first, "t").where("first < b").select("h", "first"), "recurring")
    out, _ = stored(light.select("doc_id", "th", "line_no", "h").join(recurring, "h").where("doc_id > first").groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("drop")), "dropped-lines")
    dropped(spark, light_path, to_path, seen_path, recurring_path)
    return out


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least: int = LEAST, similarity: float = SIMILARITY, counts: tuple[str, str] = ("umbra_lines", "umbra_dropped")) -> DataFrame:
    """docs with the text that is left, and two more columns, named by counts: lines before and lines
    dropped (a column of such a name in docs gives way)."""
    docs = docs.drop(*(c for c in counts if c not in (id_col, text_col)))
    key, th, drop, lines, held = fresh(docs, "umbra_id", "umbra_th", "umbra_drop", "umbra_split", "umbra_key")
    found = find(docs, id_col, text_col, depth, least, similarity).toDF(key, th, drop)
    # the text travels as its lines, so that it is split once
    columns = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    cut = docs.select(*columns, F.split(F.col(f"`{text_col}`"), "\n", -1).alias(lines), F.col(f"`{id_col}`").cast("long").alias(held), F.xxhash64(f"`{text_col}`").alias(f"{th}_"))
    joined = cut.join(found, (F.col(held) == F.col(key)) & (F.col(f"{th}_") == F.col(th)), "left")
    left = F.expr(f"if({drop} is null, {lines}, transform(array_except(sequence(0, size({lines}) - 1), {drop}), i -> {lines}[i]))")
    made = {text_col: F.array_join(left, "\n"), counts[0]: F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines)).cast("long"), counts[1]: F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long")}
    return joined.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in (*docs.columns, *counts)])
