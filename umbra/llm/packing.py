"""Variable-capacity best-fit packing of documents into training sequences.

A sequence of length c costs c * (1 + c / ATTENTION) + SEQUENCE_COST: its tokens, attention that grows
with the square of its length, and an overhead of its own.  A plan first weighs all permitted lengths
against each other, bin by bin: under each length that holds the largest item left, what the largest
items that still have room would fill it with.  The length whose contents cost least a token is
planned, its cost being that of the smallest permitted length that holds these contents.  So a long
length is planned only where what is left fills it well enough to make up for its attention.

Then the items are placed by best fit, the largest first: each goes to the open bin with least room left
for it (of equal ones the one opened first).  If none has room, the next bin of the plan that can
hold it opens; beyond the plan, the cheapest length that holds it.  At the end each bin is downsized to
the smallest permitted length that holds its contents.  A document longer than the largest length is cut
into full pieces and a rest; nothing is dropped.

Packing is sequential, so items are dealt by a hash of id, text and copy into groups of about GROUP
tokens that are packed alone; the loss is at most the last bins of each group.  A group is a few numbers
a document; the plan takes equal sizes at once, as often as their pattern repeats, and a bin takes as
many items of one size at once as it has room for.

Nulls and empty texts are items of OVERHEAD tokens (an end mark).  Repeated rows are packed each on its
own, numbered by `copy`; a null id is packed like any other.  Equal sizes go in the order of id, text
hash and copy, so the outcome doesn't depend on how the rows lie.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mapped, stored

#: Permitted lengths, a sequence's own cost in tokens, the length whose attention costs as much as its tokens,
#: tokens of a group, end marks a document, copies of a row that are numbered at once.
LENGTHS, SEQUENCE_COST, ATTENTION, GROUP, OVERHEAD, COPIES = (512, 1024, 2048, 4096), 32, 24_576, 4_000_000, 1, 1 << 14

SCHEMA = "doc_id long, text_hash long, copy long, piece int, piece_tokens int, bin string, bin_length int, bin_tokens int, bin_offset int"


def forget() -> None:
    """Lets a worker's tokenizer and its cache go."""
    from .repair import forget

    forget()


def cost(length: int) -> float:
    return length * (1 + length / ATTENTION) + SEQUENCE_COST


def patterns(counts: np.ndarray, lengths: tuple[int, ...] = LENGTHS, price: Callable[[int], float] = cost) -> Iterator[tuple[dict[int, int], int, int]]:
    """(contents, times, length) of bins for counts[n] items of size n: contents says how many of each size."""
    lengths = tuple(sorted(lengths))
    fitting = {used: next(c for c in lengths if c >= used) for used in range(1, lengths[-1] + 1)}
    left = counts.tolist()
    #: below[n]: the largest size up to n that is left, or a hint that leads there
    below = list(range(len(left)))

    def largest(n: int) -> int:
        path = []
        while n > 0 and (below[n] != n or not left[n]):
            path.append(n)
            if below[n] == n:
                below[n] = n - 1
            n = below[n]
        for x in path:
            below[x] = n
        return n

    def filled(first: int, length: int) -> tuple[dict[int, int], int]:
        held, used, top = {first: 1}, first, length
        while True:
            n = largest(min(length - used, top))
            while n > 0 and left[n] == held.get(n, 0):
                n = largest(n - 1)
            if n == 0:
                return held, used
            k = min((length - used) // n, left[n] - held.get(n, 0))
            held[n] = held.get(n, 0) + k
            used += k * n
            top = n

    while first := largest(len(left) - 1):
        best = None
        for c in lengths:
            if c >= first:
                held, used = filled(first, c)
                found = (price(fitting[used]) / used, fitting[used], held)
                if best is None or found[:2] < best[:2]:
                    best = found
        _, length, held = best
        times = min(left[n] // k for n, k in held.items())
        for n, k in held.items():
            left[n] -= k * times
        yield held, times, length


def best_fit(counts: np.ndarray, lengths: tuple[int, ...] = LENGTHS, price: Callable[[int], float] = cost) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """([(bin, size, how many, offset)], contents of each bin) for counts[n] items of size n."""
    lengths = tuple(sorted(lengths))
    planned = {c: deque() for c in lengths}
    at = 0
    for _, times, c in patterns(counts, lengths, price):
        planned[c].append((at, times))
        at += times

    def opened(n: int) -> int:
        """The length of the next planned bin that holds n, which is taken off the plan."""
        able = [c for c in lengths if c >= n]
        c = min((c for c in able if planned[c]), key=lambda c: planned[c][0], default=None)
        if c is None:
            return min(able, key=price)
        first, times = planned[c].popleft()
        if times > 1:
            planned[c].appendleft((first + 1, times - 1))
        return c

    placed, length, room = [], [], []
    #: open[r]: bins with room r, those opened first on top; some: the bits of these r
    open_, some = {}, 0
    for n in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[n])
        while left:
            fits = some >> n
            if fits:
                r = n + (fits & -fits).bit_length() - 1
                b = heappop(open_[r])
                if not open_[r]:
                    some ^= 1 << r
            else:
                b, r = len(room), opened(n)
                length.append(r)
                room.append(r)
            k = min(r // n, left)
            placed.append((b, n, k, length[b] - r))
            left -= k
            r -= k * n
            room[b] = r
            if r:
                heappush(open_.setdefault(r, []), b)
                some |= 1 << r
    return placed, [c - r for c, r in zip(length, room)]


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, price: Callable[[int], float] = cost) -> tuple[np.ndarray, ...]:
    """(bin, length, tokens, offset) of each item; sizes: at most the largest length each.

    Of equal sizes the earlier ones are placed first."""
    placed, contents = best_fit(np.bincount(sizes, minlength=max(lengths) + 1), lengths, price)
    if not placed:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    kind, size, many, offset = np.array(placed, np.int64).T
    visit = np.repeat(np.arange(len(many)), many)
    nth = np.arange(len(visit)) - np.repeat(np.cumsum(many) - many, many)
    # placed goes from large sizes to small ones, as do the items
    items = np.argsort(-np.asarray(sizes), kind="stable")
    used = np.array(contents, np.int64)
    known = np.array(sorted(lengths), np.int64)
    out = []
    for column in (kind[visit], known[np.searchsorted(known, used)][kind[visit]], used[kind[visit]], offset[visit] + nth * size[visit]):
        to = np.empty(len(visit), np.int64)
        to[items] = column
        out.append(to)
    return tuple(out)


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space, for packing without a tokenizer."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"))


def numbered(sized: DataFrame) -> DataFrame:
    """A row for each of `copies`, numbered from 1 by `copy`.  Rows of more than COPIES copies are spread in
    blocks of as many first, so that no task writes out all copies of one."""
    few, many = sized.where(F.col("copies") <= COPIES), sized.where(F.col("copies") > COPIES)
    blocks = many.withColumn("block", F.explode(F.expr(f"sequence(0, (copies - 1) div {COPIES})"))).repartition("doc_id", "text_hash", "block")
    copy = f"sequence(block * {COPIES} + 1, least(copies, (block + 1) * {COPIES}))"
    return few.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).unionByName(blocks.withColumn("copy", F.explode(F.expr(copy))).drop("block"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, tokens: Column | None = None, lengths: tuple[int, ...] = LENGTHS, group_tokens: int = GROUP) -> DataFrame:
    """A row for each piece of each row of docs: doc_id, text_hash (xxhash64 of the text), copy (which of the
    rows of this id and text), piece, piece_tokens, bin, bin_length (after downsizing), bin_tokens (its
    contents) and bin_offset (where the piece starts in the bin).

    Tokens are the ids of the tokenizer file at `path`, or what `tokens` counts (else words)."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"), (token_count(F.col(text_col)) if tokens is None else tokens).cast("long").alias("n"))
    if path is not None:
        from .repair import token_bytes

        def counted(batch):
            count = token_bytes(path).count
            return {"doc_id": batch.column(0), "text_hash": batch.column(2), "n": [count(x) if x else 0 for x in batch.column(1).to_pylist()]}

        d = mapped(d.select("doc_id", "text", "text_hash"), counted, "doc_id long, text_hash long, n long")
    sized, _ = stored(d.select("doc_id", "text_hash", (F.col("n") + OVERHEAD).alias("n")).groupBy("doc_id", "text_hash").agg(F.max("n").alias("n"), F.count("*").alias("copies")), "lengths")
    total = sized.agg(F.sum(F.col("n") * F.col("copies"))).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    top = max(lengths)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "doc_id", "text_hash", "copy"], kind="stable", na_position="first")
        n, group = pdf["n"].to_numpy(np.int64), int(pdf["g"].iloc[0])
        whole, rest = n // top, n % top
        row = np.concatenate([np.repeat(np.arange(len(n)), whole), np.flatnonzero(rest)])
        full = int(whole.sum())
        bins, length, used, offset = pack(rest[rest > 0], lengths)
        begin = np.cumsum(whole) - whole
        out = pdf[["doc_id", "text_hash", "copy"]].iloc[row].reset_index(drop=True).astype({"doc_id": "Int64"})
        out["piece"] = np.concatenate([np.arange(full) - np.repeat(begin, whole), whole[rest > 0]]).astype(np.int32)
        out["piece_tokens"] = np.concatenate([np.full(full, top), rest[rest > 0]]).astype(np.int32)
        out["bin"] = [f"{group}-{i}" for i in np.concatenate([np.arange(full), bins + full]).tolist()]
        for name, values, alone in (("bin_length", length, top), ("bin_tokens", used, top), ("bin_offset", offset, 0)):
            out[name] = np.concatenate([np.full(full, alone), values]).astype(np.int32)
        return out

    dealt = numbered(sized).withColumn("g", F.pmod(F.xxhash64("doc_id", "text_hash", "copy"), F.lit(groups)).cast("long"))
    return dealt.select("doc_id", "text_hash", "copy", "n", "g").groupBy("g").applyInPandas(run, SCHEMA)


def sequences(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, group_tokens: int = GROUP) -> DataFrame:
    """The packed sequences themselves: bin, bin_length, ids array<int> (not padded: bin_tokens of them) and
    doc_ends array<int>, where in ids each piece ends."""
    places, _ = stored(assign(docs, id_col, text_col, path, None, lengths, group_tokens), "places")
    top = max(lengths)

    def cut(batch):
        from .repair import encoded

        rows: tuple[list, ...] = ([], [], [], [])
        for doc, ids, th in zip(batch.column(0).to_pylist(), encoded(path, batch.column(1).to_pylist(), end_id), batch.column(2).to_pylist()):
            for k in range(0, len(ids), top):
                for column, x in zip(rows, (doc, th, k // top, ids[k : k + top].astype("<u4").tobytes())):
                    column.append(x)
        return dict(zip(("doc_id", "text_hash", "piece", "ids"), (pa.array(rows[0], pa.int64()), rows[1], rows[2], rows[3])))

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")).dropDuplicates(["doc_id", "text_hash"])
    pieces = mapped(d, cut, "doc_id long, text_hash long, piece int, ids binary").withColumnRenamed("doc_id", "of")
    held = places.join(pieces, F.col("doc_id").eqNullSafe(F.col("of")) & (places["text_hash"] == pieces["text_hash"]) & (places["piece"] == pieces["piece"])).select("bin", "bin_length", "bin_offset", "ids")

    def joined(batch):
        ids, ends = [], []
        for parts in batch.column(2).to_pylist():
            whole = [np.frombuffer(x["ids"], "<u4") for x in parts]
            ids.append(np.concatenate(whole).astype(np.int32))
            ends.append(np.cumsum([len(x) for x in whole]).astype(np.int32))
        return {"bin": batch.column(0), "bin_length": batch.column(1), "ids": pa.array(ids, pa.list_(pa.int32())), "doc_ends": pa.array(ends, pa.list_(pa.int32()))}

    # a bin holds the largest length at most
    bins = held.groupBy("bin", "bin_length").agg(F.array_sort(F.collect_list(F.struct("bin_offset", "ids"))).alias("parts"))
    return mapped(bins, joined, "bin string, bin_length int, ids array<int>, doc_ends array<int>")
