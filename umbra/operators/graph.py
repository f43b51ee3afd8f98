"""Re-identification by clues that subjects and outside identities share, or by a chain of links."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..errors import Refused
from ..plans.held import held

#: Quantile behind the interval of a calibrated rate; controls that it takes.
Z, CONTROLS = 1.959963984540054, 10
#: Ids of a block; clues of a block that are compared at once, on average; pairs by one clue for each row, above which ids are compared in blocks.
BLOCK, PART, CROWDED = 2048, 1 << 20, 4
#: Buckets in which clues are numbered; columns of a matrix product; a clue that one in so many pairs of a block shares is such a column; pairs made at once.
BUCKETS, COLUMNS, COMMON, AT_ONCE = 4096, 1024, 512, 1 << 19


def shared_clues(subjects: str = "{t}", identities: str = "{identities}") -> str:
    """Pairs with a clue in common and how many; both relations: id, type, value."""
    return f"SELECT s.id AS subject, i.id AS identity, count(*) AS shared FROM (SELECT DISTINCT id, type, value FROM {subjects}) s JOIN (SELECT DISTINCT id, type, value FROM {identities}) i ON s.type = i.type AND s.value = i.value GROUP BY s.id, i.id"


def verdicts(least: int, subjects: str = "{t}", identities: str = "{identities}") -> str:
    """The same by all pairs with a clue in common."""
    return f"""
WITH p AS ({shared_clues(subjects, identities)}),
b AS (SELECT subject, max(shared) AS best FROM p GROUP BY subject),
w AS (SELECT p.subject, max(b.best) AS best, count(*) AS winners FROM p JOIN b ON p.subject = b.subject AND p.shared = b.best GROUP BY p.subject),
s AS (SELECT DISTINCT id FROM {subjects})
SELECT s.id AS subject, coalesce(w.best, 0) AS best_shared, coalesce(w.winners, 0) AS winners,
       CASE WHEN coalesce(w.best, 0) < {least} THEN 'clear' WHEN w.winners = 1 THEN 'inferred' ELSE 'ambiguous' END AS verdict
FROM s LEFT JOIN w ON s.id = w.subject
"""


def _coded(subjects: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both as (id, code), and the codes as (code, s_n, i_n).

    A clue of subjects and a clue of identities that equal each other have a number, and so many holders; clues that one side alone has have
    none.  Numbers are counted in buckets.  Null types and values match nothing."""
    from ..plans.sql import over

    s, i = (held(d.select("id", "type", "value").where("type IS NOT NULL AND value IS NOT NULL").distinct()) for d in (subjects, identities))
    clues = "(SELECT type, value, count(*) AS n FROM {%s} GROUP BY type, value)"
    codes = held(
        over(
            f"""
SELECT *, b + {BUCKETS} * (row_number() OVER (PARTITION BY b ORDER BY s_type, s_value, i_type, i_value) - 1) AS code
FROM (SELECT s.type AS s_type, s.value AS s_value, s.n AS s_n, i.type AS i_type, i.value AS i_value, i.n AS i_n, pmod(xxhash64(s.type, s.value), {BUCKETS}) AS b
      FROM {clues % "t"} s JOIN {clues % "i"} i ON s.type = i.type AND s.value = i.value)""",
            s, i=i,
        )
    )
    coded = (held(over(f"SELECT x.id, n.code FROM {{t}} x JOIN {{n}} n ON x.type = n.{side}_type AND x.value = n.{side}_value", d, n=codes)) for side, d in (("s", s), ("i", i)))
    return *coded, codes.select("code", "s_n", "i_n")


def _crowded(pairs: DataFrame, s: DataFrame, i: DataFrame) -> bool:
    """Whether clues make more pairs (n: by clue) than CROWDED for each row of s and i."""
    return (pairs.agg(F.sum(F.col("n").cast("double"))).first()[0] or 0) > CROWDED * (s.count() + i.count())


def _in_blocks(s: DataFrame, i: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """What `run` makes of each block of s with each of i; rows: id, weight (by id), code.

    Ids are dealt to blocks by hash.  A row holds an id's codes, or a part of them, and goes to the task of each block of the
    other side.  So codes are moved, as often as there are blocks, and pairs never."""
    from ..plans.sql import over

    sizes = [d.groupBy("id").count().agg(F.count("*").alias("ids"), F.sum("count").alias("n")).first() for d in (s, i)]
    blocks = [max(1, math.ceil(x["ids"] / BLOCK)) for x in sizes]
    parts = max(1, *[math.ceil((x["n"] or 0) / b / PART) for x, b in zip(sizes, blocks)])
    sides = []
    for side, (d, of, own, other) in enumerate(((s, i, "s", "i"), (i, s, "i", "s"))):
        block, part = F.pmod(F.xxhash64("id"), F.lit(blocks[side])).cast("int").alias(own), F.pmod("code", F.lit(parts)).cast("int").alias("part")
        listed = d.groupBy(block, "id", "weight", part).agg(F.collect_list("code").alias("codes"))
        placed = over(f"SELECT *, dense_rank() OVER (PARTITION BY {own} ORDER BY id) - 1 AS place FROM {{t}}", listed)
        more = {f"{own}_id": F.col("id"), f"{other}_id": F.lit(None).cast(of.schema["id"].dataType), other: F.explode(F.sequence(F.lit(0), F.lit(blocks[1 - side] - 1)))}
        sides.append(placed.withColumns(more).select("s", "i", "part", F.lit(side).alias("side"), "place", "s_id", "i_id", "weight", "codes"))
    return sides[0].union(sides[1]).repartition(min(math.prod(blocks), 10_000), "s", "i").sortWithinPartitions("s", "i", "part", "side").mapInArrow(run, schema)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """((s, i, part), its rows), of rows in this order."""
    key, found = None, []
    for b in batches:
        names = np.stack([b.column(k).to_numpy() for k in range(3)])
        for lo, hi in pairwise([*np.flatnonzero(np.r_[True, (names[:, 1:] != names[:, :-1]).any(axis=0)]), b.num_rows] if b.num_rows else []):
            if tuple(names[:, lo]) != key:
                if found:
                    yield key, pa.Table.from_batches(found)
                key, found = tuple(names[:, lo]), []
            found.append(b.slice(lo, hi - lo))
    if found:
        yield key, pa.Table.from_batches(found)


def _common(s_row: np.ndarray, s_code: np.ndarray, i_row: np.ndarray, i_code: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """How many codes each row of s has in common with each of i: common codes by matrix products, rare ones by their pairs."""
    out = np.zeros(shape, np.int32)
    known, s_code = np.unique(s_code, return_inverse=True)
    if not len(known):
        return out
    at = np.searchsorted(known, i_code).clip(max=len(known) - 1)
    hit = known[at] == i_code
    i_row, i_code = i_row[hit], at[hit]
    s_n, i_n = np.bincount(s_code, minlength=len(known)), np.bincount(i_code, minlength=len(known))
    common = s_n * i_n * COMMON > out.size
    column = np.where(common, np.cumsum(common) - 1, -1)
    for k in range(0, common.sum(), COLUMNS):  # sums of a product stay exact in single precision
        sides = []
        for row, c, n in ((s_row, column[s_code], shape[0]), (i_row, column[i_code], shape[1])):
            own = (c >= k) & (c < k + COLUMNS)
            sides.append(np.zeros((n, width := min(COLUMNS, common.sum() - k)), np.float32))
            np.add.at(sides[-1].reshape(-1), row[own] * width + c[own] - k, np.float32(1))
        out += (sides[0] @ sides[1].T).astype(np.int32)
    rare = np.flatnonzero(~common[s_code])
    rare = rare[np.argsort(s_code[rare], kind="stable")]
    n = np.where(common, 0, s_n)
    first, own = np.cumsum(n) - n, np.flatnonzero(n[i_code])
    ends = np.cumsum(n[i_code[own]])
    lo = 0
    while lo < len(own):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
        mine, code = own[lo:hi], i_code[own[lo:hi]]
        each = n[code]
        of_s = np.repeat(first[code] - np.cumsum(each) + each, each) + np.arange(each.sum())
        np.add.at(out.reshape(-1), s_row[rare[of_s]] * np.int64(shape[1]) + np.repeat(i_row[mine], each), np.int32(1))
        lo = hi
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """(ids of s, ids of i, weights of i, common clues) of each pair of blocks."""
    pair, counts, rows = None, None, []

    def whole() -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
        t = pa.concat_tables(rows).combine_chunks()
        out = []
        for side, name in enumerate(("s_id", "i_id")):
            own = np.flatnonzero(t["side"].to_numpy() == side)
            own = own[np.unique(t["place"].to_numpy()[own], return_index=True)[1]]
            out.append(t[name].take(own).combine_chunks())
        return *out, t["weight"].to_numpy()[own], counts

    for (*found, _), t in _parts(batches):
        if found != pair:
            if rows:
                yield whole()
            pair, counts, rows = found, np.zeros((0, 0), np.int32), []
        rows.append(t.drop_columns("codes"))
        side, place, codes = t["side"].to_numpy(), t["place"].to_numpy(), t["codes"].combine_chunks()
        each, codes = codes.value_lengths().to_numpy(), codes.flatten().to_numpy()
        row, of_i = np.repeat(place, each), np.repeat(side, each) == 1
        shape = tuple(max(n, int(place[side == k].max(initial=-1)) + 1) for k, n in enumerate(counts.shape))
        counts = np.pad(counts, [(0, n - m) for n, m in zip(shape, counts.shape)])
        counts += _common(row[~of_i], codes[~of_i], row[of_i], codes[of_i], shape)
    if rows:
        yield whole()


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for s, i, _, counts in _counted(batches):
        step = max(1, AT_ONCE // max(1, len(i)))
        for lo in range(0, len(s), step):
            some = counts[lo : lo + step].ravel()
            at = np.flatnonzero(some)
            a, b = np.divmod(at, max(1, len(i)))
            yield pa.RecordBatch.from_arrays([s.take(pa.array(a + lo)), i.take(pa.array(b)), pa.array(some[at].astype(np.int64))], ["subject", "identity", "shared"])


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for s, i, weights, counts in _counted(batches):
        best = counts.max(axis=1, initial=0)
        winners = np.zeros(len(s), np.int64)
        step = max(1, AT_ONCE // max(1, len(i)))
        for lo in range(0, len(s), step):
            a, b = np.divmod(np.flatnonzero(counts[lo : lo + step] == best[lo : lo + step, None]), max(1, len(i)))
            np.add.at(winners, a + lo, weights[b])
        own = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([s.take(pa.array(own)), pa.array(best[own].astype(np.int64)), pa.array(winners[own])], ["k", "shared", "winners"])


def all_shared_clues(subjects: DataFrame, identities: DataFrame) -> DataFrame:
    """The rows of shared_clues(): by a join where it makes few rows, else in blocks, so that pairs aren't moved."""
    from ..plans.sql import over

    s, i, codes = _coded(subjects, identities)
    if not _crowded(codes.selectExpr("CAST(s_n AS DOUBLE) * i_n AS n"), s, i):
        return over("SELECT s.id AS subject, i.id AS identity, count(*) AS shared FROM {t} s JOIN {i} i ON s.code = i.code GROUP BY s.id, i.id", s, i=i)
    schema = StructType([StructField("subject", s.schema["id"].dataType), StructField("identity", i.schema["id"].dataType), StructField("shared", LongType(), False)])
    return _in_blocks(*(d.withColumn("weight", F.lit(1).cast("long")) for d in (s, i)), _listed, schema)


def best_matches(subjects: DataFrame, identities: DataFrame, least: int) -> DataFrame:
    """The rows of verdicts() without the pairs that share a common clue alone.

    Subjects with equal clues are one, as are identities; equal sets are told by two sums of hashes and
    their number, so no list of an id's clues is made.  Identities that share two clues with a subject
    share one that isn't its commonest: candidates come from the other clues, and the commonest one is
    looked up for these alone.  Where no identity shares two, those that share one are counted clue by
    clue.  A clue costs the distinct sets of subjects that have a commoner one, times the distinct sets of
    identities that have it; where that is much more than there are clues, sets are compared in blocks, which
    only a subject's best and their number leave.  Null types and values match nothing; a null identity
    counts as one."""
    from ..plans.sql import over

    sets = f"""
WITH n AS (SELECT id, struct(count(*), sum(CAST(xxhash64(code) AS DECIMAL(20))), sum(CAST(xxhash64(1, code) AS DECIMAL(20)))) AS name FROM {{t}} GROUP BY id),
b AS (SELECT *, pmod(xxhash64(name), {BUCKETS}) AS b FROM n)
SELECT id, b + {BUCKETS} * (dense_rank() OVER (PARTITION BY b ORDER BY name) - 1) AS k, row_number() OVER (PARTITION BY b, name ORDER BY id) = 1 AS first FROM b"""
    s, i, codes = _coded(subjects, identities)
    s_of, i_of = held(over(sets, s)), held(over(sets, i))
    s_sets, i_sets = (held(over("SELECT o.k, x.code FROM {t} x JOIN {of} o ON x.id <=> o.id WHERE o.first", d, of=of)) for d, of in ((s, s_of), (i, i_of)))
    known = held(over("SELECT s.k, struct(n.i_n AS n, s.code) AS c FROM {t} s JOIN {n} n ON s.code = n.code", s_sets, n=codes))
    rest = "top AS (SELECT k, max(c) AS c, sum(c.n) AS n FROM {known} GROUP BY k), rest AS (SELECT x.k, x.c.code FROM {known} x JOIN top ON x.k = top.k WHERE x.c <> top.c)"
    size = "size AS (SELECT k, count(*) AS members FROM {i_of} GROUP BY k)"
    pairs = "WITH %s SELECT CAST(s.n AS DOUBLE) * i.n AS n FROM (SELECT code, count(*) AS n FROM rest GROUP BY code) s JOIN (SELECT code, count(*) AS n FROM {i_sets} GROUP BY code) i ON s.code = i.code"
    if _crowded(over(pairs % rest, known, known=known, i_sets=i_sets), s_sets, i_sets):
        weighed = over(f"WITH {size} SELECT x.k AS id, size.members AS weight, x.code FROM {{t}} x JOIN size ON x.k = size.k", i_sets, i_of=i_of)
        found = _in_blocks(s_sets.selectExpr("k AS id", "CAST(1 AS BIGINT) AS weight", "code"), weighed, _nearest, StructType([StructField(c, LongType()) for c in ("k", "shared", "winners")]))
        best = over(
            """
WITH several AS (SELECT k, max(struct(shared, winners)) AS w FROM (SELECT k, shared, sum(winners) AS winners FROM {t} GROUP BY k, shared) GROUP BY k)
SELECT o.id, v.w.shared AS best, v.w.winners FROM {s_of} o JOIN several v ON o.k = v.k WHERE o.id IS NOT NULL""",
            found, s_of=s_of,
        )
    else:
        best = over(
            f"""
WITH {size}, {rest},
q AS (SELECT x.k, y.k AS i, count(*) AS shared FROM rest x JOIN {{i_sets}} y ON x.code = y.code GROUP BY x.k, y.k),
p AS (SELECT q.k, q.shared + CASE WHEN y.k IS NULL THEN 0 ELSE 1 END AS shared, size.members
      FROM q JOIN top ON q.k = top.k JOIN size ON q.i = size.k LEFT JOIN {{i_sets}} y ON y.k = q.i AND y.code = top.c.code),
several AS (SELECT k, max(struct(shared, winners)) AS w FROM (SELECT k, shared, sum(members) AS winners FROM p WHERE shared > 1 GROUP BY k, shared) GROUP BY k)
SELECT o.id, coalesce(v.w.shared, 1) AS best, coalesce(v.w.winners, top.n) AS winners
FROM {{t}} o JOIN top ON o.k = top.k LEFT JOIN several v ON o.k = v.k WHERE o.id IS NOT NULL""",
            s_of, known=known, i_sets=i_sets, i_of=i_of,
        )
    return over(
        f"""
WITH every AS (SELECT DISTINCT id FROM {{t}})
SELECT e.id AS subject, coalesce(b.best, 0) AS best_shared, coalesce(b.winners, 0) AS winners,
       CASE WHEN coalesce(b.best, 0) < {least} THEN 'clear' WHEN b.winners = 1 THEN 'inferred' ELSE 'ambiguous' END AS verdict
FROM every e LEFT JOIN {{best}} b ON e.id = b.id""",
        subjects, best=best,
    )


def reachability(edges: DataFrame, starts: DataFrame, most_hops: int | None = None) -> DataFrame:
    """(start, node, hops): nodes that start reaches along src -> dst, by the fewest hops.

    A frontier joins the edges hop by hop; nodes already seen from a start are left out by an anti-join.
    Without a bound it goes on while there is a frontier, each hop's rows being held as a table."""
    frontier = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"))
    seen, hop = frontier, 0
    while most_hops is None or hop < most_hops:
        hop += 1
        frontier = frontier.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(hop).alias("hops")).distinct()
        frontier = frontier.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        if most_hops is None:
            frontier = held(frontier)
            if frontier.isEmpty():
                break
        seen = seen.union(frontier)
    return seen.where("hops > 0")


_CLUES = "array<struct<type: string, value: string>>"
MANIFEST = f"authorized boolean, subjects array<struct<subject_id: string, clues: {_CLUES}>>, auxiliary_identities array<struct<identity_id: string, clues: {_CLUES}>>, relationship_edges array<struct<`from`: string, `to`: string, type: string>>, clue_catalog {_CLUES}, subject_sources array<struct<subject_id: string, files: array<string>>>"


def _need(right: bool, code: str) -> None:
    if not right:
        raise Refused(code)


def _people(rows: DataFrame, column: str, id_name: str) -> DataFrame:
    """(id, type, value) of an array of people with clues; ids are unique, clues and their parts not empty."""
    people = rows.select(F.explode(column).alias("p")).select(F.col(f"p.{id_name}").alias("id"), "p.clues")
    wrong = "coalesce(id, '') = '' or coalesce(size(clues), 0) <= 0 or exists(clues, c -> coalesce(c.type, '') = '' or coalesce(c.value, '') = '')"
    found = people.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(F.expr(wrong)).alias("wrong")).first()
    _need(found["n"] > 0 and found["wrong"] == 0 and found["ids"] == found["n"], f"graph-{column.replace('_', '-')}")
    return people.select("id", F.explode("clues").alias("c")).select("id", "c.type", "c.value")


def _from_carriers(rows: DataFrame, folder: Path) -> tuple[DataFrame, DataFrame]:
    """(subject ids, their clues): the catalogue's terms, as whole words in any case, that a subject's files hold."""
    from ..sources.formats import ADAPTERS, strings

    catalog = rows.select(F.explode("clue_catalog").alias("c")).select("c.type", "c.value")
    found = catalog.agg(F.count("*").alias("n"), F.count_if(F.expr("coalesce(type, '') = '' or coalesce(value, '') = ''")).alias("wrong")).first()
    _need(found["n"] > 0 and found["wrong"] == 0, "graph-clue-catalog")
    sources = rows.select(F.explode("subject_sources").alias("s")).select(F.col("s.subject_id").alias("id"), "s.files")
    wrong = "coalesce(id, '') = '' or coalesce(size(files), 0) <= 0 or exists(files, f -> coalesce(f, '') = '')"
    found = sources.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(F.expr(wrong)).alias("wrong")).first()
    _need(found["n"] > 0 and found["wrong"] == 0 and found["ids"] == found["n"], "graph-subject-sources")
    files = sources.select("id", F.explode("files").alias("file"))
    root, to = folder.resolve(), {}
    for (name,) in files.select("file").distinct().collect():  # paths of a manifest, not contents
        path = root / name
        _need(path.resolve().is_relative_to(root) and path.is_file() and not path.is_symlink() and path.suffix in (".json", ".csv", ".txt") and path.suffix in ADAPTERS, "graph-carrier")
        to[name] = path.resolve().as_uri()
    spark = rows.sparkSession
    contents = spark.read.format("binaryFile").load(sorted(set(to.values()))).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")

    def texts(batches):
        import os

        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": ["\n".join(strings(bytes(c), os.path.splitext(p)[1])) for p, c in zip(pdf["path"], pdf["content"])]})

    paths = spark.createDataFrame([(k, v.removeprefix("file://")) for k, v in to.items()], "file string, path string")
    text = files.join(paths, "file").join(contents.mapInPandas(texts, "path string, text string"), "path").select("id", "text")
    term = F.concat(F.lit("(?iuU)(?<!\\w)\\Q"), F.replace("value", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?!\\w)"))
    clues = text.join(catalog, F.regexp_like("text", term)).select("id", "type", "value").distinct()
    return sources.select("id"), clues


def attack(spark: SparkSession, manifest: str, least: int = 2) -> DataFrame:
    """A row for each subject of a graph manifest (JSON): id, best_shared, winners, linked, verdict.

    A subject that relationship edges lead to one identity is `inferred`, to several `ambiguous`; else the
    identities that share most clues decide, if these are `least` or more.  Refuses manifests without
    authorisation, repeated ids or edges, empty clues, unknown ends of edges, carriers outside its folder."""
    _need(least >= 2, "graph-least")
    rows = spark.read.schema(MANIFEST).json(manifest, multiLine=True, mode="FAILFAST")
    first = rows.select("authorized", F.col("subject_sources").isNotNull().alias("carriers")).first()
    _need(first is not None and first["authorized"] is True, "graph-authorization")
    if first["carriers"]:
        ids, clues = _from_carriers(rows, Path(manifest).parent)
    else:
        clues = _people(rows, "subjects", "subject_id")
        ids = clues.select("id").distinct()
    identities = _people(rows, "auxiliary_identities", "identity_id")
    edges = rows.select(F.explode("relationship_edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.type")
    nodes = ids.select(F.concat(F.lit("subject:"), "id").alias("node")).union(identities.select(F.concat(F.lit("identity:"), "id")).distinct())
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).where("node like 'subject:%' or node like 'identity:%'")
    found = edges.agg(F.count("*").alias("n"), F.countDistinct("src", "dst").alias("pairs"), F.count_if(F.expr("coalesce(src, '') = '' or coalesce(dst, '') = '' or not type <=> 'contextual_link'")).alias("wrong")).first()
    _need(found["wrong"] == 0 and found["pairs"] == found["n"] and ends.join(nodes, "node", "left_anti").isEmpty(), "graph-edges")
    starts = ids.select(F.concat(F.lit("subject:"), "id").alias("start"))
    linked = reachability(edges.select("src", "dst"), starts).where("node like 'identity:%'").groupBy("start").agg(F.count("*").alias("linked"))
    base = best_matches(clues, identities, least)
    out = ids.join(base, ids["id"] == base["subject"], "left").join(linked, F.concat(F.lit("subject:"), "id") == F.col("start"), "left")
    verdict = F.expr("case when linked = 1 then 'inferred' when linked > 1 then 'ambiguous' else coalesce(verdict, 'clear') end")
    return out.select("id", F.coalesce("best_shared", F.lit(0)).alias("best_shared"), F.coalesce("winners", F.lit(0)).alias("winners"), F.coalesce("linked", F.lit(0)).alias("linked"), verdict.alias("verdict"))


def summary(found: DataFrame) -> dict:
    """Counts of attack() and the verdict: `block` if any subject is inferred or ambiguous."""
    row = found.agg(F.count("*").alias("subjects"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("inferred", "ambiguous", "clear")], F.max("best_shared").alias("maximum_shared")).first().asDict()
    return {"verdict": "block" if row["inferred"] or row["ambiguous"] else "clear", **row}


def calibrated(score: int, t: str = "{t}") -> str:
    """The re-identified share of controls (shared, reidentified) with this score, with its interval."""
    from .attacks import wilson

    low, high = wilson("hits", "n", Z)
    return f"""
WITH c AS (SELECT count(*) AS n, count(CASE WHEN reidentified THEN 1 END) AS hits FROM {t} WHERE shared = {score})
SELECT n AS controls, hits, CASE WHEN n >= {CONTROLS} THEN round(CAST(hits / n AS DOUBLE), 9) END AS rate,
       CASE WHEN n >= {CONTROLS} THEN round(CAST({low} AS DOUBLE), 9) END AS low, CASE WHEN n >= {CONTROLS} THEN round(CAST({high} AS DOUBLE), 9) END AS high FROM c
"""
