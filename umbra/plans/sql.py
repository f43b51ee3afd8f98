"""SQL text over DataFrames: operators are declared as relational plans and left to Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame


def over(text: str, first: DataFrame, **more: DataFrame) -> DataFrame:
    """The query `text`, in which {t} stands for `first` and other names for the frames given; no view stays behind."""
    return first.sparkSession.sql(text, t=first, **more)
