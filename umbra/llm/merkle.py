"""Document fingerprints as Merkle trees: segments, paragraphs, sections, root.

A paragraph is a line; it is cut into segments of about 24 characters wherever a hash of the WINDOW
characters before says so, so an edit moves no cut but those near it.  A segment has LEAST to MOST
characters (a line's last one may have fewer); where no hash fires in time, the cut is after the least
hash in reach, which the characters pick as well: repeated words and scripts without blanks are cut, too.
A segment's hash covers its characters, a
paragraph's its segments' hashes, a section's its paragraphs'; a section ends after a paragraph whose
hash says so.  The root is the hash of the sections' hashes, so equal texts, and only they (but for
collisions of 128 bits), have equal roots.  Trees are compared from the root down; only differing
branches are entered, and what differs at the bottom locates the edits.

The fingerprint is the tree as text: the root, then by section its hash and by paragraph its hash and its
segments' ones, shortened to 32 bits below the root.  Two fingerprints are compared from the root down:
equal roots end it, of the rest equal sections, then equal paragraphs are matched without a look at what
is below them, and only differing branches are entered.  The likeness is the Dice coefficient of the
segments (short hashes, so that it may err by chance collisions, one in 2^32 a pair of segments); the
branches left over say where the texts differ.

A null text counts as empty (one empty segment).  Rows of one id are ordered by a hash of their text; a
null id sorts first; equal rows follow one another.  A table of one row has itself as next; an empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped

#: Of so many places one is a cut; of so many paragraphs one ends a section; hex digits of a segment.
CUT, SECTION, SHORT = 16, 4, 8
#: Characters that a cut depends on; least (at least WINDOW) and largest length of a segment.
WINDOW, LEAST, MOST = 6, 8, 64
#: What a null id counts as.
LOW = -(2**63)


def _h(data: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def _segments(text: str) -> Iterator[list[str]]:
    """By line, consecutive segments that make it up; no hash that is looked at reaches into another line."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(max(0, len(code) - WINDOW + 1), np.uint32)  # h[i]: of the characters before i + WINDOW
    for k in range(WINDOW):
        h = (h + code[k : k + len(h)]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    places = [*(np.flatnonzero(h % CUT == 0) + WINDOW).tolist(), len(text) + 1]
    i = end = 0
    for line in text.split("\n"):
        at, end = end, end + len(line)
        out = []
        while end - at > LEAST:
            while places[i] < at + LEAST:
                i += 1
            cut = places[i]
            if cut > at + MOST:
                cut = at + LEAST + int(h[at + LEAST - WINDOW : min(at + MOST, end) - WINDOW + 1].argmin()) if end - at > MOST else end
            if cut >= end:
                break
            out.append(text[at:cut])
            at = cut
        out.append(text[at:end])
        end += 1
        yield out


class Tree:
    """sections: [(hash, [(hash, [segment hashes])])]; segments keep their order."""

    def __init__(self, text: str):
        self.sections: list[tuple[bytes, list[tuple[bytes, list[bytes]]]]] = []
        held: list[tuple[bytes, list[bytes]]] = []
        for segments in _segments(text):
            leaves = [_h(s.encode("utf-8", "surrogatepass")) for s in segments]
            held.append((_h(b"p" + b"".join(leaves)), leaves))
            if held[-1][0][0] % SECTION == 0:
                self.sections.append((_h(b"s" + b"".join(x for x, _ in held)), held))
                held = []
        if held:
            self.sections.append((_h(b"s" + b"".join(x for x, _ in held)), held))
        self.root = _h(b"r" + b"".join(x for x, _ in self.sections))

    def __str__(self) -> str:
        short = lambda x: x.hex()[:SHORT]
        return self.root.hex() + ":" + ";".join(short(s) + "=" + "|".join(short(p) + "," + ",".join(map(short, leaves)) for p, leaves in ps) for s, ps in self.sections)


def _sections(fingerprint: str) -> list[tuple[str, list[str]]]:
    """(hash, paragraphs as text) of each section."""
    return [(s[:SHORT], s[SHORT + 1 :].split("|")) for s in fingerprint[33:].split(";")]


def compare(a: str, b: str) -> tuple[float, list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(likeness, differing runs of a, differing runs of b); a run is (paragraph, first, last segment)."""
    if a[:32] == b[:32]:
        return 1.0, [], []
    sides = _sections(a), _sections(b)
    equal = [Counter(s for s, _ in side) for side in sides]
    equal_sections = equal[0] & equal[1]
    total, rest = 0, []
    for side in sides:
        left, open_, paragraph = Counter(equal_sections), [], 0
        for s, ps in side:
            if left[s] > 0:  # an equal section: not entered, only its segments counted
                left[s] -= 1
                total += sum(p.count(",") for p in ps)
            else:
                open_ += [(paragraph + i, p) for i, p in enumerate(ps)]
            paragraph += len(ps)
        rest.append(open_)
    matched = total
    equal_paragraphs = Counter(p for _, p in rest[0]) & Counter(p for _, p in rest[1])
    leaves: list[list[tuple[int, int, str]]] = []
    for open_ in rest:
        left, below = Counter(equal_paragraphs), []
        for at, p in open_:
            if left[p] > 0:
                left[p] -= 1
                matched += p.count(",")
                total += p.count(",")
            else:
                below += [(at, i, x) for i, x in enumerate(p.split(",")[1:])]
        total += len(below)
        leaves.append(below)
    equal_leaves = Counter(x for _, _, x in leaves[0]) & Counter(x for _, _, x in leaves[1])
    matched += 2 * equal_leaves.total()
    runs: list[list[tuple[int, int, int]]] = []
    for below in leaves:
        left, out = Counter(equal_leaves), []
        for at, i, x in below:
            if left[x] > 0:
                left[x] -= 1
            elif out and out[-1][0] == at and out[-1][2] == i - 1:
                out[-1] = (at, out[-1][1], i)
            else:
                out.append((at, i, i))
        runs.append(out)
    return min(matched / total, 1 - 1e-9), *runs


def likeness(a: str, b: str) -> float:
    """Of two fingerprints: 1 for equal roots, else the Dice coefficient of their segments, below 1."""
    return compare(a, b)[0]


def edits(old: str, new: str) -> list[tuple[str, int, int]]:
    """(`gone` or `new`, paragraph number, segment number) of what differs between two texts."""
    _, a, b = compare(str(Tree(old)), str(Tree(new)))
    return [(kind, p, i) for kind, runs in (("gone", a), ("new", b)) for p, first, last in runs for i in range(first, last + 1)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, root, fingerprint) for each row."""

    def run(batch):
        trees = [Tree(x or "") for x in batch.column(1).to_pylist()]
        return {id_col: batch.column(0), "root": [t.root.hex() for t in trees], "fingerprint": [str(t) for t in trees]}

    d = docs.select(F.col(id_col), F.col(text_col))
    return mapped(d, run, f"`{id_col}` {d.schema[0].dataType.simpleString()}, root string, fingerprint string")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits string"


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Each text against its edited text, whose last quarter is the start of the next document's (in
    ascending order of ids; after the last: the first), and against the next one.  edits: where the
    edited text differs, as paragraph:first-last segment, joined by commas.

    Documents are dealt by ranges of ids and hashes, as many as the session has shuffle partitions, and
    sorted; a task looks one document ahead.  What it needs beyond its last document, the first of the
    following range, is sent there as well, so texts move once.  The driver holds two numbers a range.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("th", F.xxhash64("text"))
    ids = d.select(F.coalesce("doc_id", F.lit(LOW)).alias("id"), "th")
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = ids.repartitionByRange(ranges, "id", "th").groupBy(F.spark_partition_id()).agg(F.min(F.struct("id", "th")).alias("first")).select("first.*")
    firsts = sorted({(r["id"], r["th"]) for r in firsts.collect()})
    start_id, start_th = (np.array([x[i] for x in firsts], np.int64) for i in range(2))
    ranges = max(1, len(firsts))

    def range_of(at: np.ndarray, th: np.ndarray) -> np.ndarray:
        """The last range that starts at or before (at, th)."""
        lo, hi = np.searchsorted(start_id, at, "left"), np.searchsorted(start_id, at, "right")
        part = hi - 1
        for i in np.flatnonzero(hi > lo).tolist():  # ids at which ranges start
            part[i] = lo[i] + np.searchsorted(start_th[lo[i] : hi[i]], th[i], "right") - 1
        return part

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text", "th", "part", "ahead"]
        for b in batches:
            if not b.num_rows:
                continue
            at, th = b.column(0).fill_null(LOW).to_numpy(), b.column(2).to_numpy()
            part = range_of(at, th)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32)), pa.array(np.zeros(len(part), bool))], names=names)
            first: dict[int, tuple[bytes, int]] = {}
            for i in np.flatnonzero((start_id[part] == at) & (start_th[part] == th)).tolist():
                text = b.column(1)[i].as_py().encode()
                if part[i] not in first or text < first[part[i]][0]:
                    first[part[i]] = (text, i)
            if first:
                rows = pa.array([i for _, i in first.values()])
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in b.columns), pa.array([(int(k) - 1) % ranges for k in first], pa.int32()), pa.array([True] * len(first))], names=names)

    dealt = d.mapInArrow(tagged, "doc_id long, text string, th long, part int, ahead boolean").repartitionById(ranges, "part").sortWithinPartitions("part", "ahead", "doc_id", "th", "text").select("doc_id", "text", "part", "ahead")

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(EDITED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, None  # doc_id, text, fingerprint; range
        for b in batches:
            out: list[tuple] = []
            for doc, text, part, ahead in zip(*(b.column(i).to_pylist() for i in range(4))):
                if part != now:
                    last, now = None, part
                elif last is None:
                    continue  # another copy of the document ahead
                mark = str(Tree(text))
                if last is not None:
                    own, n = last[1], len(last[1])
                    cut = n // 4
                    new = own[: n - cut] + text[:cut]
                    new_mark = str(Tree(new))
                    near, _, runs = compare(last[2], new_mark)
                    out.append((last[0], n, hashlib.sha256(new.encode()).hexdigest(), last[2], new_mark, near, likeness(last[2], mark), ",".join(f"{p}:{i}-{j}" for p, i, j in runs)))
                last = None if ahead else (doc, text, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema)], schema=schema)

    return dealt.mapInArrow(run, EDITED)
