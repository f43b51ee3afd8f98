"""A corpus pipeline: language ID, line dedup, near-dedup, redaction, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and, but for the
last, returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import langid, linededup, minhash, packing, pii
from umbra.llm.shared import dropped, fresh, scratch, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter in it, or n-grams that the learned languages
    lack (no support, or less than held-out labelled texts have).  Texts in any learned language stay; a
    document without a label gets the predicted one.  Repeated rows and ids, null ids too, are judged row
    by row; where nothing is labelled, nothing stays."""
    model = langid.fit(docs.where(~langid.held_out()))
    least = langid.least_support(docs.where(langid.held_out()), model)
    found = langid.predict(docs.withColumn("row", F.struct(*COLUMNS)), model, id_col="row", support=True)
    found = found.where(f"lang_pred <> 'und' and support > 0 and support >= {least!r}D")
    return found.select(*[F.coalesce("row.lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"row.{c}") for c in COLUMNS])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring line templates and recurring short lines, and documents of which nothing but blanks
    is left.  Null texts and null ids stay as they are; rows of one id are one document."""
    gone = "umbra_dropped"
    d = linededup.clean(docs.select(*COLUMNS))
    d = d.where(f"{gone} = 0 or text rlike '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]'")
    return d.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near copies (five-word shingles, 0.8).
    Rows that repeat an id with another text are other documents; of rows that repeat id and text one
    stays.  Rows with a null id, null and empty texts are near copies of nothing and stay."""
    th, again = fresh(docs, "umbra_th", "umbra_again")
    found = minhash.near_copies(docs.select("doc_id", "text"), by_text=True).where("doc_id is not null")
    found, _ = stored(found.groupBy("doc_id", F.col("text_hash").alias(th)).agg(F.max("kept").alias("stays"), F.count("*").alias(again)).where(f"not stays or {again} > 1"), "copies")
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias(th))
    once = keyed.join(found.select("doc_id", th), ["doc_id", th], "left_anti")
    repeated = keyed.join(found.where("stays").select("doc_id", th), ["doc_id", th], "left_semi").dropDuplicates(["doc_id", th])
    return once.union(repeated).select(*COLUMNS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind's name.  Null and empty texts stay; rows are judged one by one."""
    d = pii.redact(docs.select(*COLUMNS))
    return d.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, by its token ids.  Null and empty texts are an end mark each;
    repeated rows are packed each on its own, null ids like any other."""
    import public_tokenizers

    return packing.assign(docs, path=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("line dedup", lines), ("near-dedup", near_copies), ("PII", redacted), ("packing", packed)]

#: Language ID and packing can't be expressed in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again.  What a stage stored on its way goes once
    its rows are written, its predecessor's rows as well."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            docs, path = stored(out, "stage", keep=True)
        if old:
            dropped(spark, old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
