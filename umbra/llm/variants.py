"""Spelling variants: a trie self-join of the vocabulary with active-node sets.

Words are the maximal runs of letters of a corpus, counted over whole texts.  Two are near if one inserted,
deleted or replaced code point tells them apart.  Such words share at least half of their letters at the front
or at the back: of a pair whose shorter word has m code points the first q = m // 2 or the last m - q.  So the
vocabulary becomes tries below equal fronts, and tries of reversed words below equal backs, one for each m, dealt
out by prefix.  Within a trie the nodes at distance one of a node (its active nodes) come from those of its
parent: the parent (a letter deleted), the parent's other children (replaced), its own children (inserted), and
the children by the same letter of the parent's active nodes.  Where a word ends, the words that end at its
active nodes are near.  A pair that shares front and back is told by its front trie alone.

A trie of more than GROUP words is walked by several tasks, each for its share of the words; its size is bounded
by the alphabet to the power of m - q + 1, not by the corpus.

A null text has no words; a null id counts as an empty string in the hash that plants errors (words()).  Rows
count each on their own, repeated ones too.  Ties go to the word that is smaller in code-point order.  Empty
tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Code points that a word has, and its occurrences, at least; how much more frequent a form is; words of a walk.
LENGTH, OCCURRENCES, RATIO, GROUP = 6, 5, 5, 4096
#: Words that a task counts before it hands them on.
HELD = 200_000
_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = None, length: int = LENGTH) -> DataFrame:
    """(word, n) of runs of letters with A-Z lower-cased, of at least so many code points; with `every`, a
    run of which the CRC-32 of `<id>:<run>` is divisible by it loses the code point at that hash modulo its length."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                start = zlib.crc32(f"{key.as_py() or ''}:".encode())
                for run, n in Counter(runs.findall(text.as_py() or "")).items():
                    word = run if run.islower() else run.translate(_LOWER)
                    if every:
                        h = zlib.crc32(word.encode(), start)
                        if h % every == 0:
                            i = h % len(word)
                            word = word[:i] + word[i + 1 :]
                    total[word] = total.get(word, 0) + n
                if len(total) > HELD:
                    yield out()
                    total = {}
        if total:
            yield out()

    found = docs.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).cast("string").alias("t")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.char_length("word") >= length)


def _walk(members: list[str], own: set[str]) -> Iterator[tuple[str, str]]:
    """Pairs (word of own, word of members) at distance one, by active nodes.  A node: its children, its word."""
    root: list = [{}, None]
    for w in members:
        node = root
        for c in w:
            node = node[0].setdefault(c, [{}, None])
        node[1] = w
    paths: list = [{}, None]
    for w in own:
        node = paths
        for c in w:
            node = node[0].setdefault(c, [{}, None])
        node[1] = w
    # (node, the same node among the words to walk for, its active nodes at distance one)
    todo = [(root, paths, {id(x): x for x in root[0].values()})]
    while todo:
        node, path, near = todo.pop()
        if path[1] is not None:
            for x in near.values():
                if x[1] is not None:
                    yield path[1], x[1]
        for c, below in path[0].items():
            child = node[0][c]
            active = {id(node): node} | {id(x): x for x in node[0].values()} | {id(x): x for x in child[0].values()}
            for x in near.values():
                if (y := x[0].get(c)) is not None:
                    active[id(y)] = y
            active.pop(id(child), None)
            todo.append((child, below, active))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries, one after the other, of rows sorted by key."""

    def pairs(key: tuple, group: list[tuple[str, int, bool]]) -> Iterator[tuple]:
        back, m = key[:2]
        q = m // 2
        cut = (lambda w: w[::-1][m - q :]) if back else (lambda w: w[q:])
        count = {w: n for w, n, _ in group}
        rest = {cut(w): w for w in count}
        own = {cut(w) for w, _, mine in group if mine and len(w) == m}
        if len(rest) < 2 or not own:
            return
        for a, b in _walk(list(rest), own):
            a, b = rest[a], rest[b]
            if (len(b) > m or a < b) and not (back and a[:q] == b[:q]):
                yield a, b, count[b]
                yield b, a, count[a]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "near", "near_n"])

    at, group, out = None, [], []
    for b in batches:
        for *key, word, n, mine in zip(*(b.column(c).to_pylist() for c in ("back", "m", "part", "slice", "word", "n", "mine"))):
            if key != at:
                if len(group) > 1:
                    out += pairs(at, group)
                at, group = key, []
                if len(out) > 50_000:
                    yield batch(out)
                    out = []
            group.append((word, n, mine))
    if len(group) > 1:
        out += pairs(at, group)
    if out:
        yield batch(out)


def near_words(vocabulary: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, near, near_n), both ways, of all pairs of (word, n) at distance one, each once; words are distinct."""
    spark = vocabulary.sparkSession
    classes = F.explode(F.expr(f"filter(array(char_length(word), char_length(word) - 1), x -> x >= {LENGTH})"))
    d = vocabulary.select("word", "n", classes.alias("m")).withColumn("back", F.explode(F.array(F.lit(0), F.lit(1))))
    d = d.withColumn("part", F.expr("if(back = 0, left(word, cast(m div 2 as int)), right(word, m - cast(m div 2 as int)))"))
    sizes, _ = stored(d.groupBy("back", "m", "part").agg(F.count("*").alias("size")).where("size > 1").withColumn("slices", F.expr(f"cast(ceil(size / {group}) as int)")).drop("size"), "tries")
    d = d.join(sizes, ["back", "m", "part"])
    d = d.withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)"))).withColumn("mine", F.expr("pmod(hash(word), slices) = slice"))
    keys = ["back", "m", "part", "slice"]
    return d.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "word", "n", "mine").mapInArrow(_joined, "word string, near string, near_n long")


def grouped(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, root, form, n, n_near, form_n): a word's form is its near word of largest n, if that is at least
    `ratio` times its own; its root is where the forms lead."""
    best = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
    d = vocabulary.join(best, "word", "left").withColumn("likely", F.expr(f"-best.k >= {ratio} * n"))
    d, _ = stored(d.select("word", F.expr("if(likely, best.near, null)").alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.expr("if(likely, -best.k, null)").alias("form_n")), "forms")
    # forms grow by `ratio` at each step, so chains are short; each round doubles what a pointer spans
    to, _ = stored(d.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while not (further := to.join(to.select(F.col("word").alias("root"), F.col("root").alias("next")), "root")).isEmpty():
        to, _ = stored(further.select("word", F.col("next").alias("root")).union(to.join(to.select(F.col("word").alias("root")), "root", "left_anti").select("word", "root")), "roots")
    return d.join(to, "word", "left").select("word", F.coalesce("root", "word").alias("root"), "form", "n", "n_near", "form_n")
