"""What a release still holds or has lost, row by row: locations, subjects, literals."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..errors import Refused


def locations(expected: DataFrame, output: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, code) of rows that are missing, added, repeated or different (by column, `differs:name`).

    Keys with nulls match each other, nulls equal nulls only, and columns of other types are refused: 1 isn't
    `1`.  A key that one side repeats is reported and its rows aren't compared.  Empty tables give no rows."""
    for c in (*keys, *columns):
        if expected.schema[c].dataType != output.schema[c].dataType:
            raise Refused("type-differs")
    row = F.struct(*[F.col(c) for c in columns])
    once = [d.groupBy(*keys).agg(F.count("*").alias(f"{side}_n"), F.first(row).alias(f"{side}_row")).select(F.struct(*keys).alias(f"{side}_key"), f"{side}_n", f"{side}_row") for d, side in ((expected, "a"), (output, "b"))]
    both = once[0].join(once[1], F.col("a_key").eqNullSafe(F.col("b_key")), "full").select(F.coalesce("a_key", "b_key").alias("key"), "*")
    codes = [F.when(~F.col(f"a_row.{c}").eqNullSafe(F.col(f"b_row.{c}")), F.lit(f"differs:{c}")) for c in columns]
    found = F.when(F.col("b_n").isNull(), F.array(F.lit("missing"))).when(F.col("a_n").isNull(), F.array(F.lit("added")))
    found = found.when((F.col("a_n") > 1) | (F.col("b_n") > 1), F.array(F.lit("repeated"))).otherwise(F.array_compact(F.array(*codes)))
    return both.select(*[F.col(f"key.{k}").alias(k) for k in keys], F.explode(found).alias("code"))


def subjects(tokens: DataFrame, source: DataFrame, output: DataFrame) -> DataFrame:
    """(type, identity, code): identities whose token isn't theirs alone within the type (`shared-token`), or
    that the source holds while the output lacks their token (`token-missing`).

    tokens: (type, identity, token); source: (type, identity) as found; output: (token) as found.  Null
    identities and tokens are no one's."""
    known = tokens.select("type", "identity", "token").where("identity is not null and token is not null").distinct()
    shared = known.groupBy("type", "token").agg(F.count("*").alias("n")).where("n > 1").select("type", "token")
    a = known.join(shared, ["type", "token"], "left_semi").withColumn("code", F.lit("shared-token"))
    lost = known.join(source.select("type", "identity"), ["type", "identity"], "left_semi").join(output.select("token"), "token", "left_anti")
    return a.select("type", "identity", "code").union(lost.select("type", "identity", F.lit("token-missing").alias("code"))).distinct()


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def leaks(rows: DataFrame, key: str, columns: list[str], values: list[str]) -> DataFrame:
    """(key, column, value): each of the values that a cell still holds, as written or composed alike (NFC).

    Values may overlap; all that occur are given.  Only texts beyond ASCII are composed.  Cells that aren't
    text are read as Spark writes them; nulls and empty values hold nothing.  values: a policy's."""
    wanted = sorted({v for v in values if v})
    if not wanted:
        return rows.select(key, F.lit("").alias("column"), F.lit("").alias("value")).limit(0)
    cells = [rows.select(F.col(key), F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in columns]
    d = reduce(DataFrame.union, cells).where("cell is not null")
    plain = d.where("not cell rlike '[^\\\\x00-\\\\x7F]'").withColumn("composed", F.col("cell"))
    other = d.where("cell rlike '[^\\\\x00-\\\\x7F]'").withColumn("composed", _composed("cell"))
    held = [F.when(F.contains("cell", F.lit(v)) | F.contains("composed", F.lit(unicodedata.normalize("NFC", v))), F.lit(v)) for v in wanted]
    return plain.union(other).select(key, "column", F.explode(F.array_compact(F.array(*held))).alias("value"))
