"""Near-duplicate documents by HyperMinHash.

A document is the set of its word shingles.  Its sketch deals the shingles' hashes into 128 buckets and
keeps of each bucket's smallest hash the count of leading zeros (6 bits) and 10 bits of mantissa: 16
bits a register.  Bands of four registers are the keys under which documents meet; the Jaccard
similarity, estimated from the registers and corrected for chance collisions, drops clearly different
pairs, and of short texts all but few by the count of registers that differ; the others are confirmed on their full shingle sets.

Documents with equal sets are one node.  Of a key's nodes each is first held against the smallest
alone; then, where a key still joins several components, those outside the key's largest one are
compared with one another and with its members, in tiles of bounded size (members of the largest
component never with one another): a document with the likeliest member of each other component first,
then with those members that the exact distance to the first one doesn't rule out.  So groups of any
size lose no link and are not expanded into all pairs.  A linked pair (similarity 0.8) misses all 32
bands with probability below 1e-7, and the estimate may lie five standard deviations low.

Words are runs of characters other than ASCII white space, A-Z lower-cased.  With fewer words than a
shingle has, the whole sequence is the one shingle; without words (or text) the set is empty and
linked with nothing.  A row with a null id is linked with nothing (component null, kept).  Rows with
one id are one document: whatever links with one of its texts is linked with all of them, a text without
words too (n_shingles is each row's own).  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, dropped, mapped, small_batches, stored

#: Words of a shingle, similarity in percent; registers, registers of a band; documents of a tile's side.
WORDS, PERCENT, REGISTERS, BAND, TILE = 5, 80, 128, 4, 256
#: Pairs of sets that a worker takes at once (a long document's set is as large as its text).
PAIRS = 64
#: Words that are hashed at once; entries of a worker's word cache, bytes of a word that it takes at most.
CHUNK, CACHE, SHORT = 200_000, 250_000, 64
#: Mantissa bits; the constant of expected collisions of two registers (Yu and Weber, HyperMinHash).
MANTISSA, COLLISIONS = 10, 0.169919487159739093975315012348630288992889

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


class _Words(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(word) <= SHORT:
            self[word] = h
        return h


_WORDS = _Words()


def forget() -> None:
    """Empties a worker's cache."""
    _WORDS.clear()


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text, the sorted 64-bit hashes of its distinct shingles."""
    known = _WORDS
    if len(known) > CACHE:
        known.clear()
    hashes: list[int] = []
    sizes: list[int] = []

    def sets() -> Iterator[np.ndarray]:
        w = np.array(hashes, np.uint64)
        h = _mixed(w + np.uint64(words))
        n = len(w) - words + 1
        if n > 0:
            h = w[:n]
            for k in range(1, words):
                h = _mixed(h * _B + w[k : k + n])
            h = _mixed(h + np.uint64(words))
        at = 0
        for size in sizes:
            if size >= words:
                s = np.sort(h[at : at + size - words + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif size:
                one = w[at : at + 1]
                for k in range(1, size):
                    one = _mixed(one * _B + w[at + k : at + k + 1])
                yield _mixed(one + np.uint64(size))
            else:
                yield np.zeros(0, np.uint64)
            at += size
        hashes.clear()
        sizes.clear()

    for text in texts:
        ws = text.encode().lower().split() if text else []
        hashes += [known[x] for x in ws]
        sizes.append(len(ws))
        if len(hashes) >= CHUNK:
            yield from sets()
    yield from sets()


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (rows x REGISTERS, 16 bits; 0: nothing fell there)."""
    out = np.zeros(len(sets) * REGISTERS, np.uint16)
    if sets and sum(map(len, sets)):
        h = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        bits = REGISTERS.bit_length() - 1
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
        rest = (h << np.uint64(bits) | np.uint64(1)).astype(np.float64)
        m, e = np.frexp(rest / 2.0**64)
        zeros = np.minimum(63, 1 - e).astype(np.uint16)
        low = np.uint16((1 << MANTISSA) - 1) - np.minimum((1 << MANTISSA) - 1, (m - 0.5) * (2 << MANTISSA)).astype(np.uint16)
        np.maximum.at(out, owner * REGISTERS + bucket, zeros << np.uint16(MANTISSA) | low)
    return out.reshape(-1, REGISTERS)


def band_keys(registers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all bands that hold anything."""
    b = np.ascontiguousarray(registers).view(np.uint64) if BAND == 4 else None
    row, band = np.nonzero(b)
    return row, _mixed(b[row, band] * _A + _mixed(band.astype(np.uint64) + np.uint64(1))).view(np.int64)


def likely(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of registers (arrays that broadcast) may reach the similarity: the estimate, less
    expected collisions, lies within five standard deviations, and the sets' sizes allow it; no more registers
    differ than a linked pair's sets have elements that aren't common, as each such element changes one at most."""
    same = ((a == b) & (a > 0)).sum(axis=-1)
    filled = ((a > 0) | (b > 0)).sum(axis=-1)
    ratio = size_a / np.maximum(1, size_b)
    chance = COLLISIONS * REGISTERS / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    estimate = np.maximum(0, same - chance) / np.maximum(1, filled)
    t = percent / 100
    fits = 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)
    fits = fits & ((100 + percent) * (filled - same) <= (100 - percent) * (size_a + size_b))
    return fits & (estimate >= t - 5 * np.sqrt(t * (1 - t) / np.maximum(1, filled)))


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first `keys` columns (all whole numbers)."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            now = tuple(k[i])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _likeliest(percent: int):
    """Of a tile's documents and components, the pairs that may be similar with the best estimate, one
    for a document and another component, from the side that has fewer documents in the tile.

    Rows: key, whether the largest component's members are the right side, ti, tj, id, component, size,
    own block, whether it's such a member, registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 4):
            n = t.num_rows
            if n < 2:
                continue
            ids, comp, size, own = (t.column(i).to_numpy() for i in range(4, 8))
            major = t.column(8).to_numpy().astype(bool)
            regs = np.frombuffer(b"".join(t.column(9).to_pylist()), np.uint16).reshape(n, REGISTERS)
            against, ti, tj = (t.column(i)[0].as_py() for i in (1, 2, 3))
            both = not against and ti == tj
            if against:
                left, right = np.flatnonzero(~major), np.flatnonzero(major)
            else:
                left, right = (np.arange(n), np.arange(n)) if both else (np.flatnonzero(own == ti), np.flatnonzero(own == tj))
            bands = regs.view(np.uint64)
            key = t.column(0)[0].as_py()
            out: list[tuple[np.ndarray, ...]] = []
            for at in range(0, len(left), 32):
                rows = left[at : at + 32]
                x, y = np.nonzero(comp[rows][:, None] != comp[right][None, :])
                if both:
                    keep = rows[x] < right[y]
                    x, y = x[keep], y[keep]
                x, y = rows[x], right[y]
                for i in range(0, len(x), 4096):  # bounds what is compared at once
                    u, v = x[i : i + 4096], y[i : i + 4096]
                    # a pair counts under the first key that it shares
                    shared = ((bands[u] == bands[v]) & (bands[u] > 0)).argmax(axis=1)
                    here = _mixed(bands[u, shared] * _A + _mixed(shared.astype(np.uint64) + np.uint64(1))).view(np.int64) == key
                    u, v = u[here], v[here]
                    ok = likely(regs[u], regs[v], size[u], size[v], percent)
                    u, v = u[ok], v[ok]
                    if len(u):
                        out.append((u, v, (regs[u] == regs[v]).sum(axis=1)))
            if not out:
                continue
            x, y, score = (np.concatenate(z) for z in zip(*out))
            at, count = np.unique(comp, return_inverse=True, return_counts=True)[1:]
            swap = (count[at[x]] > count[at[y]]) | ((count[at[x]] == count[at[y]]) & (comp[x] > comp[y]))
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            order = np.lexsort((ids[y], -score, at[y], x))
            x, y = x[order], y[order]
            first = np.ones(len(x), bool)
            first[1:] = (x[1:] != x[:-1]) | (at[y][1:] != at[y][:-1])
            x, y = x[first], y[first]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], names=["a", "b"])

    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Common elements of two sorted arrays of distinct ones."""
    both = np.sort(np.concatenate([x, y]))
    return int((both[1:] == both[:-1]).sum())


def _linked_members(percent: int):
    """Links between a component's members and documents outside, in tiles: full sets where the
    estimates allow a link, and no more links than it takes to connect.

    Rows: component, ti, tj, whether it's a member, id, size, registers, set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 3):
            member = t.column(3).to_numpy()
            ids, size = t.column(4).to_numpy(), t.column(5).to_numpy()
            regs = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint16).reshape(len(ids), REGISTERS)
            sets = [np.frombuffer(x, np.uint64) for x in t.column(7).to_pylist()]
            inside = np.flatnonzero(member)
            u, v = [], []
            for x in np.flatnonzero(~member).tolist():
                for y in inside[likely(regs[x][None, :], regs[inside], size[x], size[inside], percent)].tolist():
                    common = _common(sets[x], sets[y])
                    if 100 * common >= percent * (size[x] + size[y] - common):
                        u.append(ids[x])
                        v.append(ids[y])
                        break  # the members are connected already
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) with the distance of their full sets, and whether it is small enough to link them."""

    def run(batch):
        far, linked = [], []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            m, n = len(x) // 8, len(y) // 8
            common = _common(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
            far.append(1 - common / (m + n - common))
            linked.append(100 * common >= percent * (m + n - common))
        return {"u": batch.column(0), "v": batch.column(1), "far": far, "linked": linked}

    j = pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a").select("a", "b", "set_a", "set_b")
    return mapped(j, run, "u long, v long, far double, linked boolean")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, tile: int = TILE, by_text: bool = False) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row: the size of its set, the smallest id that
    links reach, and whether that is its own.

    With by_text, rows of one id with other texts are other documents: there is one more column,
    text_hash (xxhash64 of the text), and of a component only the smallest (id, text_hash) is kept."""
    import xxhash

    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))

    def featured(batch):
        n, digest, regs = [], [], []
        held: list[np.ndarray] = []
        for s in shingle_sets(batch.column(1).to_pylist(), words):
            n.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()))
            held.append(s)
            if len(held) >= 256:
                regs += [x.tobytes() for x in sketch(held)]
                held = []
        regs += [x.tobytes() for x in sketch(held)]
        return {"doc_id": batch.column(0), "th": batch.column(2), "n": n, "digest": digest, "sketch": regs}

    feats, feats_path = stored(mapped(d, featured, "doc_id long, th long, n long, digest binary, sketch binary"), "features")
    # nodes are numbered, as ids may repeat with other texts; the numbers are final once the table is written
    valid = feats.where("n > 0 and doc_id is not null")
    reps = valid.groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("who"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    reps, reps_path = stored(reps.select(F.monotonically_increasing_id().alias("rep"), "digest", "who.doc_id", "who.th", "n", "sketch"), "sketches")
    several = valid.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("x"), F.max(F.xxhash64("digest")).alias("y")).where("x <> y").select("doc_id")
    several, several_path = stored(valid.select("doc_id", "digest").join(several, "doc_id").distinct().join(reps.select("digest", "rep"), "digest").select("doc_id", "rep"), "ids")
    same_id = several.groupBy("doc_id").agg(F.min("rep").alias("u")).join(several, "doc_id").select("u", F.col("rep").alias("v"))

    def banded(batch):
        regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        row, key = band_keys(regs)
        return {"key": pa.array(key), "rep": batch.column(0).take(pa.array(row))}

    bands = mapped(reps.select("rep", "sketch"), banded, "key long, rep long")
    shared = bands.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("n")).where("lo < hi").drop("hi")
    shared, shared_path = stored(shared, "keys")
    rows, rows_path = stored(bands.join(shared, "key"), "buckets")
    dropped(spark, shared_path)
    active = rows.select("rep").distinct()

    def as_sets(batch):
        return {"rep": batch.column(0), "set": [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), words)]}

    texts = d.join(reps.join(active, "rep").select("doc_id", "th", "rep"), ["doc_id", "th"]).groupBy("doc_id", "th").agg(F.first("rep").alias("rep"), F.first("text").alias("text"))
    sets, sets_path = stored(mapped(texts.select("rep", "text"), as_sets, "rep long, set binary"), "sets")

    # first: each document of a key with the key's smallest
    def estimated(batch):
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
        ok = likely(a, b, *(batch.column(i).to_numpy() for i in (2, 3)), percent)
        return {"a": batch.column(0).filter(pa.array(ok)), "b": batch.column(1).filter(pa.array(ok))}

    stars, stars_path = stored(rows.where("rep <> lo").select(F.col("lo").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    sk = reps.select("rep", "n", "sketch")
    met = stars.join(sk.toDF("a", "na", "sa"), "a").join(sk.toDF("b", "nb", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb")
    pairs, pairs_path = stored(mapped(met, estimated, "a long, b long"), "pairs")
    few_sets = small_batches(sets, sets_path, PAIRS)
    seen, seen_path = stored(_compared(small_batches(pairs, pairs_path, PAIRS), few_sets, percent), "links")
    seen = spark.read.schema(seen.schema).parquet(seen_path)
    edges = seen.where("linked").select("u", "v")
    dropped(spark, stars_path, pairs_path)
    # then: what a key still joins across components, in tiles
    comp, comp_path = stored(components(edges).toDF("rep", "component"), "components")
    own_far = seen.select(F.col("u").alias("c"), F.col("v").alias("rep"), "far")
    nodes = active.join(comp, "rep", "left").select("rep", F.coalesce("component", "rep").alias("c"), F.col("component").isNotNull().alias("many"))
    nodes = nodes.join(own_far, ["c", "rep"], "left").select("rep", "c", "many", F.when(F.col("rep") == F.col("c"), F.lit(0.0)).otherwise(F.coalesce("far", F.lit(float("nan")))).alias("far"))
    nodes, nodes_path = stored(nodes, "nodes")

    labelled, labelled_path = stored(rows.select("key", "rep", "n").join(nodes.select("rep", "c"), "rep"), "labelled")
    sizes = labelled.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "c")).alias("top"), F.sum("m").alias("n"), F.count("*").alias("parts"))
    sizes = sizes.where("parts > 1").select("key", F.col("top.c").alias("top"), F.expr(f"cast(ceil(top.m / {tile}) as int)").alias("kt"), F.expr(f"cast(ceil((n - top.m) / {tile}) as int)").alias("ko"))
    mixed, mixed_path = stored(sizes, "mixed")
    dealt = labelled.join(mixed, "key").withColumn("major", F.expr("c = top")).withColumn("own", F.expr("cast(pmod(xxhash64(rep), if(major, kt, ko)) as int)"))
    among = "if(major, array(), transform(sequence(0, ko - 1), i -> named_struct('against', 0, 'ti', least(i, own), 'tj', greatest(i, own))))"
    against = "if(major, transform(sequence(0, ko - 1), i -> named_struct('against', 1, 'ti', i, 'tj', own)), transform(sequence(0, kt - 1), j -> named_struct('against', 1, 'ti', own, 'tj', j)))"
    dealt = dealt.withColumn("at", F.explode(F.expr(f"concat({among}, {against})"))).join(sk.withColumnRenamed("n", "size"), "rep")
    dealt = dealt.select("key", "at.against", "at.ti", "at.tj", "rep", "c", "size", "own", F.col("major").cast("int").alias("major"), "sketch")
    pairs, pairs_path = stored(dealt.repartition("key", "against", "ti", "tj").sortWithinPartitions("key", "against", "ti", "tj").mapInArrow(_likeliest(percent), "a long, b long").distinct(), "pairs")
    met, met_path = stored(_compared(small_batches(pairs, pairs_path, PAIRS), few_sets, percent), "links")
    met = spark.read.schema(met.schema).parquet(met_path)
    linked = edges.union(met.where("linked").select("u", "v"))
    newer, newer_path = stored(components(linked).toDF("rep", "new"), "components")
    # d(x, m) >= d(x, m') - d(m', s) - d(s, m): one exact distance d(x, m') rules out a component
    # whose members m lie near its smallest, s; against all others x is held in full
    both = seen.union(met).select("u", "v", F.col("far").alias("d"))
    both = both.union(both.select("v", "u", "d")).toDF("x", "rep", "d").join(nodes.where("many"), "rep")
    open_ = both.groupBy("x", "c").agg(F.max(F.when(F.isnan("far"), F.lit(-1.0)).otherwise(F.col("d") - F.col("far"))).alias("d"))
    widest = nodes.where("many").groupBy("c").agg(F.max("far").alias("widest"), F.count("*").alias("members"))  # NaN is the largest
    open_ = open_.join(widest, "c").where(f"isnan(widest) or d - widest <= {1 - percent / 100 + 1e-9}").drop("d", "widest")
    open_ = open_.join(newer.toDF("x", "new_x"), "x", "left").join(newer.toDF("c", "new_c"), "c", "left").where("coalesce(new_x, x) <> coalesce(new_c, c)").select("x", "c", "members")
    open_, open_path = stored(open_, "open")
    count = open_.groupBy("c").agg(F.count("*").alias("outside"), F.first("members").alias("members"))
    count, count_path = stored(count.select("c", F.expr(f"cast(ceil(outside / {tile}) as int)").alias("kx"), F.expr(f"cast(ceil(members / {tile}) as int)").alias("km")), "counts")
    outside = open_.select("x", "c").join(count, "c").select("c", F.expr("cast(pmod(xxhash64(x), kx) as int)").alias("ti"), F.explode(F.expr("sequence(0, km - 1)")).alias("tj"), F.lit(False).alias("member"), F.col("x").alias("rep"))
    inside = nodes.where("many").select("c", "rep").join(count, "c").select("c", F.explode(F.expr("sequence(0, kx - 1)")).alias("ti"), F.expr("cast(pmod(xxhash64(rep), km) as int)").alias("tj"), F.lit(True).alias("member"), "rep")
    dealt, dealt_path = stored(outside.union(inside), "dealt")
    dealt = small_batches(dealt, dealt_path, PAIRS).join(small_batches(reps, reps_path, PAIRS).select("rep", F.col("n").alias("size"), "sketch"), "rep").join(few_sets, "rep").select("c", "ti", "tj", "member", "rep", "size", "sketch", "set")
    last, last_path = stored(dealt.repartition("c", "ti", "tj").sortWithinPartitions("c", "ti", "tj").mapInArrow(_linked_members(percent), "u long, v long"), "links")
    last = spark.read.schema(last.schema).parquet(last_path)
    more = components(linked.union(last) if by_text else linked.union(last).union(same_id)).toDF("rep", "c")
    # numbers give way to ids: the smallest of a component
    named, named_path = stored(reps.select("digest", "rep", "doc_id", "th").join(more, "rep", "left").select("digest", F.coalesce("c", "rep").alias("c"), "doc_id", "th"), "named")
    least, least_path = stored(named.groupBy("c").agg(F.min(F.struct("doc_id", "th")).alias("least")), "least")
    by_set, _ = stored(named.join(least, "c").select("digest", "least"), "by-set")
    dropped(spark, several_path, labelled_path, mixed_path, rows_path, sets_path, pairs_path, seen_path, comp_path, nodes_path, met_path, newer_path, open_path, count_path, dealt_path, last_path, reps_path, named_path, least_path)
    out = feats.where("n > 0 and doc_id is not null").join(by_set, "digest").select("doc_id", "th", "n", "least")
    bare = feats.where("not (n > 0 and doc_id is not null)").select("doc_id", "th", "n")
    alone = F.struct("doc_id", "th")
    if by_text:
        bare = bare.select("doc_id", "th", "n", alone.alias("least"))
    else:  # a text without words goes with the other texts of its id, if there are any
        kin = valid.select("doc_id", "digest").join(bare.where("doc_id is not null").select("doc_id").distinct(), "doc_id").join(by_set, "digest").groupBy("doc_id").agg(F.min("least").alias("least"))
        bare = bare.join(kin, "doc_id", "left").select("doc_id", "th", "n", F.coalesce("least", alone))
    kept = F.col("doc_id").isNull() | ((alone == F.col("least")) if by_text else (F.col("doc_id") == F.col("least.doc_id")))
    return out.union(bare).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), *([F.col("th").alias("text_hash")] if by_text else []), kept.alias("kept"))
