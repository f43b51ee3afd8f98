"""Whether a released model needs its own audit, and the inversion of gradients of an affine layer.

The contract is this library's own.  For y = W x + b and a batch of one, dL/dW[i, j] = dL/db[i] * x[j]:
a row with a gradient of its bias gives the input away, and all such rows agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def applicability(release_kind: str, model: bool = False, gradients: bool = False) -> dict:
    """A file alone needs no model audit; a learned model does, by an adapter or from its gradients."""
    if release_kind not in ("file_only", "learned_model"):
        raise ValueError("unknown kind of release")
    if release_kind == "file_only":
        return {"verdict": "not_applicable"}
    return {"verdict": "gradients_available" if gradients else "adapter_required", "model": model}


def invert(weights: DataFrame, biases: DataFrame) -> DataFrame:
    """weights (i, j, g), biases (i, g): for each input j its reconstruction and whether all rows agree."""
    b = biases.where("g <> 0").select("i", F.col("g").alias("b"))
    x = weights.join(b, "i").select("j", (F.col("g") / F.col("b")).alias("x"))
    found = x.groupBy("j").agg(F.avg("x").alias("value"), (F.max("x") - F.min("x")).alias("spread"), F.count("*").alias("n"))
    return found.select("j", "value", (F.col("spread") <= TOLERANCE * F.greatest(F.abs("value"), F.lit(1.0))).alias("agree"), F.col("n").alias("evidence"))
