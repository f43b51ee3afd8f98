"""Token-id shards under Re-Pair grammars: frequent id pairs become nonterminals, again and again.

A block of a shard holds the ids of consecutive documents as one sequence.  Each round counts all
adjacent pairs, gives the most frequent ones (RULES at most) a nonterminal each and replaces their
occurrences, from left to right in a run of overlapping ones; a pair that this leaves with under WORTH
occurrences, or whose place another one has taken, gets no rule in this round.  Rounds go on, however
many, until none shortens the sequence by a share of GAIN, no pair occurs LEAST times or the symbols are
used up: sequences of copies fold up to single symbols, others end when rules cease to pay.  A block
stores its rules, each rule's expansion length and the sequence, so that any range of ids is decoded
without the rest.  Spark's writer commits the files, so a lost task leaves none behind.

A text that holds one of the vocabulary's added tokens is encoded as a whole by the tokenizers library,
any other in pieces that give the same ids.

Nulls count as empty texts (their ids are the end id alone).  Rows with the same id, equal ones too,
each keep their place, ordered by a hash of their text.  A null id sorts first.  An empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pretokens import columns, pieces
from .shared import stored

#: Ids a block (a longer document has a block of its own).
BLOCK_IDS = 2_000_000
#: Entries of a worker's cache (it keeps the first ones; frequent pieces come early), characters of one at most.
CACHE, SHORT = 500_000, 64
#: Pieces that are encoded together; characters of texts that are looked up together.
JOINED, TEXTS = 10_000, 8_000_000
#: Entries where only the number of ids is kept.
COUNTS = 500_000
#: Rules a round at most, occurrences that a pair must have to be looked at, and to get a rule; least gain of a round.
RULES, LEAST, WORTH, GAIN = 3000, 12, 6, 1 / 256

FILES = "shard int, block int, n_docs long, n_ids long, first_symbol long, doc_ids binary, doc_ends binary, rules binary, expansions binary, sequence binary"


def _occurrences(key: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, index of the pair) of the pairs' occurrences in key, without overlaps."""
    if key.dtype == np.uint32:
        place = lambda k: (k * np.uint32(0x9E3779B1)) >> np.uint32(14)
    else:
        place = lambda k: (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)
    taken, index = np.zeros(1 << 18, key.dtype), np.zeros(1 << 18, np.int32)
    at = place(pairs)[::-1]  # of two pairs in one slot the more frequent one wins
    taken[at], index[at] = pairs[::-1], np.arange(len(pairs), dtype=np.int32)[::-1]
    where = place(key)
    hit = taken[where] == key
    if pairs.min() > 0:
        hit &= key > 0  # an empty slot isn't pair 0
    # in a run of hits, those at even distance from its start
    on = np.flatnonzero(hit)
    rank = np.arange(len(on), dtype=np.int32)
    start = np.zeros(len(on), np.int32)
    first = np.flatnonzero(on[1:] - on[:-1] != 1).astype(np.int32) + np.int32(1)
    start[first] = first
    on = on[(rank - np.maximum.accumulate(start)) & 1 == 0]
    return on, index[where[on]]


def compress(ids: np.ndarray, first_symbol: int, most: int = RULES, least: int = LEAST, worth: int = WORTH, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence): row i of rules holds the two symbols behind symbol first_symbol + i.

    Symbols stay below 65536 where first_symbol does, so that they are stored in two bytes."""
    seq, rules = ids.astype(np.uint32), np.zeros((0, 2), np.uint32)
    top = 1 << 16 if first_symbol < 1 << 16 else 1 << 32
    bits = 16 if top == 1 << 16 else 32
    while (room := min(most, top - first_symbol - len(rules))) > 0 and len(seq) > 1:
        key = seq[:-1] << np.uint32(16) | seq[1:] if bits == 16 else seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:]
        order = np.sort(key)
        edge = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1])))
        count = np.diff(np.append(edge, len(order)))
        frequent = np.flatnonzero(count >= least)
        if not len(frequent):
            break
        best = frequent[np.lexsort((order[edge[frequent]], -count[frequent]))][:room]
        pairs = order[edge[best]]
        on, pair = _occurrences(key, pairs)
        used = np.bincount(pair, minlength=len(pairs)) >= min(worth, least)
        on, pair = on[used[pair]], pair[used[pair]]
        if not len(on):
            break
        number = np.cumsum(used) - 1
        before = len(seq)
        seq[on] = (first_symbol + len(rules) + number[pair]).astype(np.uint32)
        keep = np.ones(before, bool)
        keep[on + 1] = False
        seq, pairs = seq[keep], pairs[used].astype(np.uint64)
        rules = np.vstack([rules, np.column_stack([pairs >> np.uint64(bits), pairs & np.uint64((1 << bits) - 1)]).astype(np.uint32)])
        if before - len(seq) < gain * before:
            break
    return rules, seq


def expansion_lengths(rules: np.ndarray, first_symbol: int) -> np.ndarray:
    """Ids behind each rule."""
    inner, at = rules >= first_symbol, np.where(rules >= first_symbol, rules.astype(np.int64) - first_symbol, 0)
    n = np.full(len(rules), 2, np.int64)
    while True:  # as many times as rules are nested
        now = np.where(inner, n[at] if len(n) else 1, 1).sum(axis=1)
        if (now == n).all():
            return n
        n = now


class Block:
    """A stored block, ready to decode."""

    def __init__(self, row: dict):
        wide = np.dtype("<u2" if row["first_symbol"] < 1 << 16 else "<u4")
        self.first = row["first_symbol"]
        self.rules = np.frombuffer(row["rules"], wide).reshape(-1, 2)
        self.seq = np.frombuffer(row["sequence"], wide)
        self.lengths = np.frombuffer(row["expansions"], "<i4").astype(np.int64)
        self.doc_ends = np.frombuffer(row["doc_ends"], "<i8")
        self.flat = self.rules.reshape(-1).astype(np.uint32)
        while (rule := self.flat >= self.first).any():  # as many times as rules are nested
            size = np.where(rule, 2, 1)
            at = np.cumsum(size) - size
            wider = np.repeat(self.flat, size)
            wider[at[rule]], wider[at[rule] + 1] = self.rules[self.flat[rule] - self.first].T
            self.flat = wider
        self.flat_at = np.cumsum(self.lengths) - self.lengths
        self.ends: np.ndarray | None = None

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        is_rule = seq >= self.first
        if not is_rule.any():
            return seq.astype(np.uint32)
        size = np.ones(len(seq), np.int64)
        rule = seq[is_rule].astype(np.int64) - self.first
        size[is_rule] = self.lengths[rule]
        ends = np.cumsum(size)
        out = np.empty(ends[-1], np.uint32)
        starts = ends - size
        out[starts[~is_rule]] = seq[~is_rule]
        n = size[is_rule]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(starts[is_rule], n) + inner] = self.flat[np.repeat(self.flat_at[rule], n) + inner]
        return out

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from start to stop; only symbols that reach into this range are expanded."""
        if start == 0 and stop is None:
            return self._expand(self.seq)
        if self.ends is None:
            size = np.ones(len(self.seq), np.int64)
            at = self.seq >= self.first
            size[at] = self.lengths[self.seq[at].astype(np.int64) - self.first]
            self.ends = np.cumsum(size)
        stop = int(self.ends[-1]) if stop is None and len(self.ends) else stop or 0
        i, j = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left") + 1
        before = int(self.ends[i - 1]) if i else 0
        return self._expand(self.seq[i:j])[start - before : stop - before]

    def document(self, k: int) -> np.ndarray:
        """The ids of the block's k-th document."""
        return self.ids(int(self.doc_ends[k - 1]) if k else 0, int(self.doc_ends[k]))


def _spread(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin there and have these sizes, one after another."""
    stop = np.cumsum(size)
    return flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - size), size)]


class _Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: tokens that the library finds in a text before all else
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.findall = regex.compile(public_tokenizers.PATTERN).findall
        self.wide = np.uint16 if self.size < 1 << 16 else np.uint32
        #: pieces that this worker knows; where in flat the ids of each begin, and how many they are
        self.known = pa.array([], pa.large_string())
        self.begin, self.size_of = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.wide)
        self.counts: dict[str, int] = {}

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        ids, sizes = self.joined(texts)
        raw, stops = ids.tobytes(), np.cumsum(sizes) * ids.itemsize
        return [raw[i:j] for i, j in zip([0, *stops[:-1].tolist()], stops.tolist())]

    def joined(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another, how many each has); end: the id that each gets at its end.

        Arrow numbers the texts' different pieces; those that the cache lacks are encoded once for all."""
        if not texts:
            return np.zeros(0, self.wide), np.zeros(0, np.int64)
        whole = {k for k, text in enumerate(texts) if any(map(text.__contains__, self.added))}
        parts, first = columns(["" if k in whole else text for k, text in enumerate(texts)] if whole else texts, self.findall)
        last = np.append(first[1:], len(parts)) - 1
        coded = parts.dictionary_encode()
        place = pc.fill_null(pc.index_in(coded.dictionary, self.known), -1).to_numpy().astype(np.int64)
        lacking = place < 0
        new = coded.dictionary.filter(pa.array(lacking))
        place[lacking] = len(self.known) + np.arange(len(new))
        flat, size_of = self._learn(new.to_pylist())
        begin = np.cumsum(size_of) - size_of
        at = place[coded.indices.to_numpy()]
        size = np.concatenate([self.size_of, size_of])[at]
        if end is not None:
            size[last] += 1
        ids = _spread(np.concatenate([self.flat, flat, np.zeros(1, self.wide)]), np.concatenate([self.begin, begin + len(self.flat)])[at], size)
        stops = np.cumsum(size)[last]
        if end is not None:
            ids[stops - 1] = end
        self._keep(new, flat, begin, size_of)
        sizes = np.diff(stops, prepend=0)
        if whole:
            parts = np.split(ids, stops[:-1])
            for k in whole:
                parts[k] = np.concatenate([np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, self.wide), parts[k]])
            ids, sizes = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, sizes

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces, one after another, how many each has): pieces are encoded together, as words that are cut already."""
        ids, sizes = [np.zeros(0, self.wide)], [np.zeros(0, np.int64)]
        for k in range(0, len(new), JOINED):
            some = new[k : k + JOINED]
            e = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, self.wide))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _keep(self, new: pa.Array, flat: np.ndarray, begin: np.ndarray, size_of: np.ndarray) -> None:
        """Takes short pieces into the cache while it has room."""
        if not len(new) or (room := CACHE - len(self.known)) <= 0:
            return
        some = np.flatnonzero(pc.utf8_length(new).to_numpy() <= SHORT)[:room]
        self.known = pa.concat_arrays([self.known, new.take(pa.array(some))])
        size = size_of[some]
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.size_of = np.concatenate([self.size_of, size])
        self.flat = np.concatenate([self.flat, _spread(flat, begin[some], size)])

    def count(self, text: str) -> int:
        """How many ids a text has."""
        if any(map(text.__contains__, self.added)):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        total, new, counts = 0, [], self.counts
        parts = Counter(pieces(text, self.findall))
        for x, n in parts.items():
            if (ids := counts.get(x)) is None:
                new.append(x)
            else:
                total += ids * n
        for x, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False) if new else ()):
            total += len(e) * parts[x]
            if len(counts) < COUNTS and len(x) <= SHORT:
                counts[x] = len(e)
        return total


def forget() -> None:
    """Lets a worker's tokenizer and its cache go."""
    _encoder.cache_clear()


@cache
def _encoder(path: str) -> _Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _Encoder(path)


def token_bytes(path: str):
    """A function of this worker from text to its ids' little-endian bytes, two or four an id."""
    return _encoder(path)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about TEXTS characters."""
    held, size = [], 0
    for x in texts:
        held.append(x)
        size += len(x)
        if size >= TEXTS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoded(path: str, texts: list[str | None], end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text (null: empty), and end_id."""
    for some in _groups([x or "" for x in texts]):
        ids, sizes = _encoder(path).joined(some, end_id)
        yield from np.split(ids.astype(np.uint32), np.cumsum(sizes)[:-1])


def encode_files(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> tuple[DataFrame, str]:
    """Encodes every text, appends end_id, writes the ids in ascending order of id_col as compressed
    blocks to the shared folder; returns them as read back, and their place.

    Shards are ranges of ids (and of texts' hashes, so that one id may fill several), as many as the
    session has shuffle partitions; the texts move once, and a shard is as many blocks as its size asks for.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("th", F.xxhash64("text"))
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = d.repartitionByRange(shards, "doc_id", "th").sortWithinPartitions("doc_id", "th")

    def run(batches):
        encode = _encoder(path)
        wide = "<u2" if encode.size < 1 << 16 else "<u4"
        shard, block = TaskContext.get().partitionId(), 0
        held, sizes, ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, encode.wide)

        def closed(held, ends, ids):
            rules, seq = compress(ids, encode.size)
            row = (shard, block, len(held), len(ids), encode.size, held.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), rules.astype(wide).tobytes(), expansion_lengths(rules, encode.size).astype("<i4").tobytes(), seq.astype(wide).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, out)], schema=out)

        for batch in batches:
            docs, at = batch.column(0).fill_null(-(2**63)).to_numpy(), 0
            for some in _groups(batch.column(1).to_pylist()):
                more, n = encode.joined(some, end_id)
                held, sizes, ids = np.concatenate([held, docs[at : at + len(some)]]), np.concatenate([sizes, n]), np.concatenate([ids, more])
                at += len(some)
                while (ends := np.cumsum(sizes)).size and ends[-1] >= BLOCK_IDS:
                    k = int(np.searchsorted(ends, BLOCK_IDS)) + 1  # the document that fills the block is its last
                    yield closed(held[:k], ends[:k], ids[: ends[k - 1]])
                    block, held, sizes, ids = block + 1, held[k:], sizes[k:], ids[ends[k - 1] :]
        if len(held):
            yield closed(held, np.cumsum(sizes), ids)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(FILES))
    return stored(dealt.mapInArrow(run, FILES), "token-ids")


def read_files(files: DataFrame) -> DataFrame:
    """Per document of stored blocks: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian 32-bit integers), shard, block."""
    before = Window.orderBy("shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("shard", "block", "n_ids").withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).drop("n_ids")  # a row a block

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = "shard int, block int, doc_id long, inner long, n_tokens long, ids_crc32 long"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                raw = memoryview(b.ids().astype("<u4").tobytes())
                ends = b.doc_ends.tolist()
                starts = [0, *ends[:-1]]
                docs = np.frombuffer(row["doc_ids"], "<i8")
                n = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["shard"], np.int32)), pa.array(np.full(n, row["block"], np.int32)), pa.array(docs, pa.int64(), mask=docs == -(2**63)), pa.array(starts, pa.int64()), pa.array(np.diff(b.doc_ends, prepend=0)), pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(starts, ends)], pa.int64())], schema=out)

    docs = files.mapInArrow(run, schema)
    return docs.join(base, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")
