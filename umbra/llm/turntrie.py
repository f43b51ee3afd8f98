"""Prefix trie of conversations.

A conversation is the array of its turns, each the first 128 bits of the SHA-256 of role and text, so that
equal prefixes are equal arrays.  The arrays are range-sorted over all partitions; within each, the longest
common prefix (LCP) with the row before says which nodes end and which begin, and one sweep with a stack of
open nodes turns the LCP intervals into nodes with their sums.

Nodes that may go on in a neighbouring partition are those on the path of a partition's first or last row.
Of these a sweep gives partial sums under a digest of the path.  A partition's last and the next one's first
row tell, by their LCP, what both counted (the nodes of the common path, a child, a leaf); that is taken off,
and the sums meet by digest.  Such rows are few: partitions times the length of two conversations.  The ids
that end at such a node travel as packed pieces and are hashed in order, streaming.

rebuilt() gives each conversation the first turns of another (the contract of op11); trie() takes any arrays.

Rows with a null conv_id belong to no conversation.  A null turn comes first; turns of one number are ordered
by their hashes, so repeated rows are repeated turns.  Null role and text are empty.  One conversation's hashes
(16 bytes a turn) are held by one task, its texts aren't.  An empty table gives no rows, not even a root.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Conversations of a block, of which the first lends its head; ids of a piece.
BLOCK, PIECE = 20, 4096

WORDS = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, key binary, words int), a row a turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.expr("unhex(substring(umbra_sha, 1, 32))")
    d = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("umbra_sha"), F.regexp_count(text, F.lit(WORDS)).alias("words"))
    return d.select("conv_id", "turn", key.alias("key"), "words")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<key, words>>): each conversation c with the first h turns of c - c % BLOCK
    in place of its own first h, h being the CRC-32 of c's decimal form modulo 4."""
    d = turns(conversations).withColumn("block", F.expr(f"conv_id - conv_id % {BLOCK}")).repartition("block")
    d = d.groupBy("block", "conv_id").agg(F.expr("transform(sort_array(collect_list(struct(turn is not null as known, turn, key, words))), x -> struct(x.key as key, x.words as words))").alias("own"))
    head = F.expr("first(if(conv_id = block, slice(own, 1, 3), null), true) over (partition by block)")
    d = d.withColumn("head", head).withColumn("h", F.expr("cast(crc32(cast(cast(conv_id as string) as binary)) % 4 as int)"))
    return d.select("conv_id", F.expr("concat(if(head is null, slice(own, 1, 0), slice(head, 1, h)), slice(own, h + 1, size(own)))").alias("turns"))


#: Rows of a sweep, by kind: a node, a part of a node, a piece of the ids that end at it, a partition's first and last row.
NODE, PART, PIECES, EDGE = range(4)
_ROWS = "kind int, part int, seq int, digest binary, up binary, conv_id long, parent_conv_id long, depth long, n long, children long, leaves long, saved long, ends string, data binary, keys array<binary>, words array<int>"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32())}
_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (x.split(" ") for x in _ROWS.split(", "))])


def _below(digest: bytes, key: bytes) -> bytes:
    return hashlib.sha256(digest + key).digest()[:16]


#: The digest of the root.
ROOT = hashlib.sha256(b"").digest()[:16]


class _Node:
    __slots__ = ("key", "w", "digest", "least", "n", "children", "leaves", "saved", "ends", "pending")

    def __init__(self, key: bytes, w: int, digest: bytes | None):
        self.key, self.w, self.digest = key, w, digest
        self.least: int | None = None
        self.n = self.children = self.leaves = self.saved = 0
        self.ends: list[int] = []
        self.pending: list[dict] = []


def _swept(rows: Iterator[tuple[int, list[bytes], list[int]]], part: int) -> Iterator[dict]:
    """The sweep over one partition's sorted rows.  A node with a digest is partial."""
    stack: list[_Node] = []
    before: list[bytes] = []
    last = None

    def close() -> Iterator[dict]:
        x = stack.pop()
        up = stack[-1] if stack else None
        x.saved += (x.n - 1) * x.w
        x.leaves = x.leaves if x.children else 1
        if up is not None:
            up.n += x.n
            up.children += 1
            up.leaves += x.leaves
            up.saved += x.saved
            up.least = x.least if up.least is None else min(up.least, x.least)
        sums = {"conv_id": x.least, "depth": len(stack), "n": x.n, "children": x.children, "leaves": x.leaves, "saved": x.saved}
        if x.digest is not None:
            for row in x.pending:
                yield row | {"up": x.digest}
            yield {"kind": PART, "digest": x.digest, "up": up.digest if up else None, **sums}
            for k in range(0, len(x.ends), PIECE):
                yield {"kind": PIECES, "part": part, "seq": k // PIECE, "digest": x.digest, "data": ",".join(map(str, x.ends[k : k + PIECE])).encode()}
            return
        for row in x.pending:
            yield row | {"parent_conv_id": x.least}
        row = {"kind": NODE, **sums, "ends": hashlib.sha256(",".join(map(str, x.ends)).encode()).hexdigest()}
        if up.digest is not None:
            yield row | {"up": up.digest}
        else:
            up.pending.append(row)

    for conv, keys, words in rows:
        if not stack:
            yield {"kind": EDGE, "part": part, "seq": 0, "keys": keys, "words": words}
            stack.append(_Node(b"", 0, ROOT))
            for k, w in zip(keys, words):
                stack.append(_Node(k, w, _below(stack[-1].digest, k)))
        else:
            same = 0
            for a, b in zip(before, keys):
                if a != b:
                    break
                same += 1
            while len(stack) - 1 > same:
                yield from close()
            stack += [_Node(k, w, None) for k, w in zip(keys[same:], words[same:])]
        top = stack[-1]
        top.n += 1
        top.least = conv if top.least is None else min(top.least, conv)
        top.ends.append(conv)
        before, last = keys, (keys, words)
    if last:
        yield {"kind": EDGE, "part": part, "seq": 1, "keys": last[0], "words": last[1]}
        for up, x in zip(stack, stack[1:]):
            x.digest = x.digest or _below(up.digest, x.key)
        while stack:
            yield from close()


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    def rows() -> Iterator[tuple[int, list[bytes], list[int]]]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                cut = b.slice(at, 1024)
                yield from zip(*(cut.column(i).to_pylist() for i in range(3)))

    def batch(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in held], f.type) for f in _SCHEMA], schema=_SCHEMA)

    held: list[dict] = []
    for row in _swept(rows(), TaskContext.get().partitionId()):
        held.append(row)
        if len(held) == 8192:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


_SUMS = "digest binary, up binary, depth long, conv_id long, n long, children long, leaves long, saved long"


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What two neighbouring partitions both counted, for each node of their common path."""
    for b in batches:
        out: dict[str, list] = {x.split(" ")[0]: [] for x in _SUMS.split(", ")}
        for a, keys, words in zip(*(b.column(n).to_pylist() for n in ("before", "keys", "words"))):
            same = 0
            while same < min(len(a), len(keys)) and a[same] == keys[same]:
                same += 1
            total = [0, *accumulate(words)]
            digest, up = ROOT, None
            for d in range(same + 1):
                if d:
                    digest, up = _below(digest, keys[d - 1]), digest
                for n, v in zip(out, (digest, up, d, None, 0, -(d < same), -(same == len(a)), total[same] - total[max(0, d - 1)])):
                    out[n].append(v)
        types = [pa.binary(), pa.binary(), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, ends) of pieces sorted by digest, partition and number, streaming."""
    at, state = None, None
    for b in batches:
        done: list[tuple[bytes, str]] = []
        for digest, data in zip(b.column("digest").to_pylist(), b.column("data").to_pylist()):
            if digest == at:
                state.update(b",")
            else:
                if at is not None:
                    done.append((at, state.hexdigest()))
                at, state = digest, hashlib.sha256()
            state.update(data)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], names=["digest", "ends"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["digest", "ends"])


def trie(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row a node of the trie of (conv_id, turns array<struct<key, words>>), conv_ids being unique: conv_id
    (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    d = conversations.select("conv_id", F.expr("transform(turns, x -> x.key)").alias("keys"), F.expr("transform(turns, x -> x.words)").alias("words"))
    d = d.repartitionByRange(partitions, "keys", "conv_id") if partitions else d.repartitionByRange("keys", "conv_id")
    swept, _ = stored(d.sortWithinPartitions("keys", "conv_id").mapInArrow(_sweep, _ROWS), "sweep")
    # two rows a partition, however many rows those hold
    edges = swept.where(f"kind = {EDGE}").select("part", "seq", "keys", "words", F.expr("lag(keys) over (order by part, seq)").alias("before"))
    both = edges.where("seq = 0 and before is not null").select("before", "keys", "words").mapInArrow(_stitched, _SUMS)
    parts = swept.where(f"kind = {PART}").select(*[x.split(" ")[0] for x in _SUMS.split(", ")]).union(both)
    whole = parts.groupBy("digest").agg(F.max("up").alias("up"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")])
    ends = swept.where(f"kind = {PIECES}").select("digest", "part", "seq", "data").repartition("digest").sortWithinPartitions("digest", "part", "seq").mapInArrow(_hashed, "digest binary, ends string")
    whole, _ = stored(whole.join(ends, "digest", "left").withColumn("ends", F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest()))), "spanning")
    columns = ("conv_id", "depth", "parent_conv_id", "n", "children", "leaves", "saved", "ends")
    above = whole.select(F.col("digest").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    nodes = swept.where(f"kind = {NODE}")
    out = nodes.where("up is null").select(*columns)
    out = out.union(nodes.where("up is not null").drop("parent_conv_id").join(above, "up").select(*columns))
    out = out.union(whole.join(above, "up", "left").select(*columns))
    return out.toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
