"""Columns that an operator passes through without looking at them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hide(df: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """df with every column but the needed ones under a name of its own, and the names to give show()."""
    names = df.columns
    return df.toDF(*[n if n in needed else f"__c{i}" for i, n in enumerate(names)]), names


def show(df: DataFrame, names: list[str], *needed: str) -> DataFrame:
    """The columns that hide() was given, in their order and under their names."""
    return df.select(*[F.col(n if n in needed else f"__c{i}").alias(n) for i, n in enumerate(names)])
