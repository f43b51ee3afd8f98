"""The queries of the operators, opN_<name>, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import linededup

    d = linededup.clean(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("umbra_lines").alias("n_lines"), F.col("umbra_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


#: The rows (doc_id, n_lines, n_dropped, text) of the line dedup, from a relation {docs} of doc_id and text.
LINES_SQL = r"""
l AS (SELECT doc_id, i, line, trim(line) AS t, len(string_split(trim(line), ' ')) AS tokens
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {docs})),
m AS (SELECT *, CASE WHEN tokens < 5 THEN t ELSE array_to_string(list_transform(string_split(t, ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), ' ') END AS masked
      FROM l WHERE tokens >= 5 OR regexp_matches(line, '[^ \t\x0B\f\r]')),
k AS (SELECT *, [CAST(tokens AS VARCHAR)] || string_split(masked, ' ')[1:4] AS leaf FROM m),
vl AS (SELECT leaf FROM k GROUP BY leaf HAVING min(doc_id) < max(doc_id) AND min(masked) < max(masked)),
dl AS (SELECT leaf, masked, min(doc_id) AS first FROM k WHERE leaf IN (SELECT leaf FROM vl) GROUP BY ALL),
led AS (SELECT leaf, masked, first, CAST(NULL AS VARCHAR) AS leader FROM dl
        UNION ALL
        SELECT x.leaf, x.masked, x.first,
               CASE WHEN len(list_filter(list_zip(string_split(x.masked, ' '), string_split(s.lead.masked, ' ')), lambda p: p[1] = p[2])) >= 0.7 * len(string_split(x.masked, ' ')) THEN s.lead.masked END
        FROM led x JOIN (SELECT leaf, min({{'first': first, 'masked': masked}}) AS lead FROM led WHERE leader IS NULL GROUP BY leaf) s ON x.leaf = s.leaf WHERE x.leader IS NULL),
named AS (SELECT k.doc_id, k.i, coalesce(a.leader, k.masked) AS template FROM k LEFT JOIN (SELECT * FROM led WHERE leader IS NOT NULL) a ON k.leaf = a.leaf AND k.masked = a.masked),
firsts AS (SELECT template, min(doc_id) AS first FROM named GROUP BY template HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT n.doc_id, n.i FROM named n JOIN firsts f ON n.template = f.template WHERE n.doc_id > f.first),
lines_left AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_dropped,
                      coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text
               FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
"""
OP1_SQL = "WITH RECURSIVE " + LINES_SQL.format(docs="documents") + "SELECT doc_id, n_lines, n_dropped, sha256(text) AS text_sha256 FROM lines_left"


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


#: Bytes of a shard in op7.
SHARD_BYTES = 1 << 20


def op4_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    d = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(umbra_base, x -> x.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return d.select("doc_id", *counts, F.sha2(pii.as_text("umbra_base").cast("binary"), 256).alias("base_sha256"), pii.as_text("umbra_spans").alias("spans"))


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merkle

    return merkle.edited(table(spark, sf_dir, "documents"))


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_copies(table(spark, sf_dir, "documents"), words=2)


def _reached(links: str, nodes: str) -> str:
    """CTEs after which `low` holds (id, component): the smallest id that links (u, v) reach from each node."""
    return f"""
ends AS (SELECT u, v FROM {links} UNION SELECT v, u FROM {links}),
reach AS (SELECT id AS a, id AS b FROM {nodes} UNION SELECT reach.a, ends.v FROM reach JOIN ends ON reach.b = ends.u),
low AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)"""


OP6_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) > 1 THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) ELSE words END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT s.doc_id, s.shingle, n.n FROM s JOIN n ON s.doc_id = n.doc_id),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM k a JOIN k b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
          GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))),
nodes AS (SELECT DISTINCT doc_id AS id FROM documents),
{_reached("links", "nodes")}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(low.component AS BIGINT) AS component_id, d.doc_id = low.component AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN low ON d.doc_id = low.id
"""


def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.assign(table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


OP7_SQL = f"""
WITH r AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h,
                  coalesce(strlen(text), 0) AS bytes FROM documents),
     d AS (SELECT r.*, t.d, h >> (60 - t.d) AS prefix FROM r, range(0, 61) t(d)),
     s AS (SELECT *, sum(bytes) OVER (PARTITION BY d, prefix) AS b FROM d),
     m AS (SELECT doc_id, min({{'d': d, 'p': prefix, 'b': b}}) AS x FROM s WHERE b <= {SHARD_BYTES} GROUP BY doc_id)
SELECT doc_id, CASE WHEN x.d = 0 THEN '' ELSE lpad(bin(x.p), CAST(x.d AS INT), '0') END AS shard,
       CAST(x.d AS INT) AS shard_depth, CAST(x.b AS BIGINT) AS shard_bytes FROM m
"""


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.assign(table(spark, sf_dir, "documents"), path=public_tokenizers.path("byte_bpe_50k.json"))


def op9_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import vectors

    return vectors.near_copies(table(spark, sf_dir, "embeddings"))


OP9_SQL = f"""
WITH RECURSIVE x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM x WHERE len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
nodes AS (SELECT vec_id AS id FROM embeddings),
{_reached("links", "nodes")},
degree AS (SELECT u, count(*) AS n FROM ends GROUP BY u)
SELECT CAST(x.vec_id AS BIGINT) AS vec_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links, CAST(low.component AS BIGINT) AS component_id, x.vec_id = low.component AS kept
FROM x JOIN low ON x.vec_id = low.id LEFT JOIN degree ON degree.u = x.vec_id
"""


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import repair

    files, _ = repair.encode_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return repair.read_files(files)


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import turntrie

    return turntrie.trie(turntrie.rebuilt(table(spark, sf_dir, "conversations")))


#: Of so many runs one loses a letter in op12.
PLANTED = 199


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import variants
    from .shared import stored

    vocabulary, _ = stored(variants.words(table(spark, sf_dir, "documents"), every=PLANTED).where(f"n >= {variants.OCCURRENCES}"), "vocabulary")
    return variants.grouped(vocabulary)


def op13_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import wrapper

    return wrapper.extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_template_lines, op2_byte_bpe, op3_language_bitmask, op4_boosted_pii, op5_merkle, op6_hyperminhash, op7_extendible_shards, op8_best_fit_packing, op9_epsilon_grid, op10_token_ids, op11_turn_trie, op12_spelling_variants, op13_wrapper_text)}
ORACLE_SQL: dict[str, str] = {"op1_template_lines": OP1_SQL, "op6_hyperminhash": OP6_SQL, "op7_extendible_shards": OP7_SQL, "op9_epsilon_grid": OP9_SQL}
