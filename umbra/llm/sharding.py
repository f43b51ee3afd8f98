"""Shards by extendible hashing: a directory over hash prefixes, in which only oversized buckets split.

A bucket is a prefix of the key's hash.  Bytes are summed once by prefixes of the length that an even
spread would need; buckets that hold too much, and only those, split on one more bit, again and again.
Buckets that were cut too small join their neighbours again: a row's shard is the shortest prefix that
fits the limit, which is what splitting one bit at a time from the empty prefix arrives at.  The
directory, about a row a shard, meets the rows by a shuffle; it is never sent to all executors.

A bucket of a single hash value can't split: rows of one key (copies of an id) stay together, and one
such shard may exceed the limit.  Rows with a null key have nothing in common and are spread by their
content, all columns' hash (copies of such a row stay together).  A null size counts as 0.  An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, fresh, stored

#: Hash bits; bytes of a shard.
BITS, LIMIT = 60, 64 << 20


def key_hash(key: Column, content: Column) -> Column:
    """The first 60 bits of the MD5 of the key, or of the content where that is null, as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), content.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: Column | str) -> Column:
    """The first `depth` bits of h."""
    return F.expr(f"shiftright(h, cast({BITS} - {depth} as int))")


def assign(df: DataFrame, key_col: str = "doc_id", size: Column | None = None, limit: int = LIMIT, hashed: str | None = None) -> DataFrame:
    """(key_col, shard, shard_depth, shard_bytes) for each row of df, and its hash as column `hashed` if that
    is named; shard: the prefix's bits."""
    size = F.octet_length("text") if size is None else size
    rows, path = stored(df.select(F.col(key_col).alias("key"), key_hash(F.col(key_col), F.xxhash64(*df.columns)).alias("h"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes")), "sizes")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth = min(BITS, max(0, total // max(1, limit)).bit_length())
    cells = rows.groupBy(F.lit(depth).alias("depth"), _prefix(depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    dealt = rows.withColumn("depth", F.lit(depth))
    cells, at = stored(cells, "cells")
    old = [at]
    while True:
        over = cells.where((F.col("bytes") > limit) & (F.col("lo") < F.col("hi")) & (F.col("depth") == depth))
        if depth >= BITS or over.isEmpty():
            break
        deeper = depth + 1
        over = over.select("depth", "cell", F.lit(deeper).alias("deeper"))
        dealt, at = stored(dealt.withColumn("cell", _prefix("depth")).join(over.hint("shuffle_hash"), ["depth", "cell"], "left").select("key", "h", "bytes", F.coalesce("deeper", "depth").alias("depth")), "sizes")
        old.append(at)
        finer = dealt.where(F.col("depth") == deeper).groupBy("depth", _prefix("depth").alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        cells, at = stored(cells.join(over.drop("deeper"), ["depth", "cell"], "left_anti").unionByName(finer), "cells")
        old.append(at)
        depth = deeper
    # each cell adds to all its prefixes; a cell's shard is its shortest prefix that fits, or itself
    up = cells.select(F.col("depth").alias("cell_depth"), "cell", "bytes", F.explode(F.sequence(F.lit(0), "depth")).alias("depth")).withColumn("prefix", F.expr("shiftright(cell, cell_depth - depth)"))
    buckets = up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bucket_bytes"))
    fits = up.join(buckets, ["depth", "prefix"]).where((F.col("bucket_bytes") <= limit) | (F.col("depth") == F.col("cell_depth")))
    directory = fits.groupBy("cell_depth", "cell").agg(F.min(F.struct("depth", "prefix", "bucket_bytes")).alias("s"))
    directory, at = stored(directory.select(F.col("cell_depth").alias("depth"), "cell", F.expr("case when s.depth = 0 then '' else lpad(conv(s.prefix, 10, 2), s.depth, '0') end").alias("shard"), F.col("s.depth").alias("shard_depth"), F.col("s.bucket_bytes").alias("shard_bytes")), "directory")
    return dealt.withColumn("cell", _prefix("depth")).join(directory.hint("shuffle_hash"), ["depth", "cell"]).select(F.col("key").alias(key_col), "shard", "shard_depth", "shard_bytes", *([F.col("h").alias(hashed)] if hashed else []))


def write_shards(df: DataFrame, path: str, key_col: str = "doc_id", size: Column | None = None, limit: int = LIMIT) -> None:
    """df as one folder of Parquet files per shard (rows with equal keys go to one shard)."""
    key, h = fresh(df, "umbra_key", "umbra_hash")
    to = assign(df, key_col, size, limit, hashed=h).select(F.col(h).alias(key), "shard").distinct()
    with_shard = df.withColumn(h, key_hash(F.col(key_col), F.xxhash64(*df.columns))).join(to, F.col(h) == F.col(key)).drop(key, h)
    with_shard.repartition("shard").write.partitionBy("shard").parquet(path)
