"""Typed values of JSON documents by location, and where two versions of a document differ.

A location is a JSON pointer: `` is the whole, `/a/0` the first member of `a`, with `~1` for a slash and `~0` for a tilde in a key.
Kinds are object, array (without a value; their members are rows of their own), string, integer, real, boolean and null; a number's value
is its text, so 1, 1.0, "1" and true are four values.  A document that isn't JSON, repeats a key or holds a number that isn't finite
is one row of kind `unreadable`; a null text has no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class _Integer(str):
    """A whole number as it is written."""


class _Real(str):
    """Another number as it is written."""


def _once(pairs: list) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key is repeated")
    return dict(pairs)


def _finite(text: str) -> _Real:
    if float(text) in (float("inf"), float("-inf")):
        raise ValueError("not finite")
    return _Real(text)


def _never(text: str) -> None:
    raise ValueError("not finite")


def located(text: str) -> Iterator[tuple[str, str, str | None]]:
    """(location, kind, value) of all values of a document, the whole first."""
    try:
        whole = json.loads(text, object_pairs_hook=_once, parse_int=_Integer, parse_float=_finite, parse_constant=_never)
    except (ValueError, RecursionError):
        yield "", "unreadable", None
        return
    todo = [("", whole)]
    while todo:
        at, x = todo.pop()
        if isinstance(x, dict):
            yield at, "object", None
            todo += [(f"{at}/{k.replace('~', '~0').replace('/', '~1')}", v) for k, v in reversed(x.items())]
        elif isinstance(x, list):
            yield at, "array", None
            todo += [(f"{at}/{i}", x[i]) for i in range(len(x) - 1, -1, -1)]
        elif isinstance(x, bool):
            yield at, "boolean", str(x).lower()
        elif x is None:
            yield at, "null", None
        else:
            yield at, "integer" if isinstance(x, _Integer) else "real" if isinstance(x, _Real) else "string", str(x)


#: Rows of a batch.
BATCH = 16_384


def values(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, location, kind, value): a row for each value of each document in `column`."""
    d = df.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("key"), F.col(f"`{column}`").cast("string").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, text in enumerate(b.column("text")):
                for row in located(text.as_py()):
                    rows.append((i, *row))
                    if len(rows) == BATCH:
                        yield _batch(b, rows)
                        rows = []
            if rows:
                yield _batch(b, rows)

    kind = StructType([d.schema["key"], *(StructField(n, StringType()) for n in ("location", "kind", "value"))])
    found = d.mapInArrow(run, kind)
    return found.select(*[F.col("key")[k].alias(k) for k in keys], "location", "kind", "value")


def _batch(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    key = b.column("key").take(pa.array([r[0] for r in rows], pa.int64()))
    return pa.RecordBatch.from_arrays([key, *(pa.array([r[i] for r in rows], pa.string()) for i in (1, 2, 3))], names=["key", "location", "kind", "value"])


def differences(source: DataFrame, output: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, location, code, kind_before, kind_after) of what differs between two versions of the documents: missing (in the source alone),
    extra (in the output alone), type or value.  Keys name a document once on either side; null keys are keys."""
    names = [f"umbra_key{i}" for i in range(len(keys))]
    a = values(source, keys, column).toDF(*names, "umbra_at", "kind_before", "umbra_before")
    b = values(output, keys, column).toDF(*[f"{n}_" for n in names], "umbra_at_", "kind_after", "umbra_after")
    same = F.expr(" and ".join([f"{n} <=> {n}_" for n in names] + ["umbra_at = umbra_at_"]))
    code = F.expr("case when kind_after is null then 'missing' when kind_before is null then 'extra' when kind_before <> kind_after then 'type' when not (umbra_before <=> umbra_after) then 'value' end")
    d = a.join(b, same, "full").withColumn("code", code).where("code is not null")
    here = F.col("kind_before").isNotNull()
    return d.select(*[F.when(here, F.col(n)).otherwise(F.col(f"{n}_")).alias(k) for n, k in zip(names, keys)], F.coalesce("umbra_at", "umbra_at_").alias("location"), "code", "kind_before", "kind_after")
