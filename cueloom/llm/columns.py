"""Columns by their exact names, whatever characters these hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def every(docs: DataFrame) -> list[Column]:
    """All columns of a table in their order."""
    return [exact(c) for c in docs.columns]


def set_aside(docs: DataFrame) -> tuple[list[Column], list[str]]:
    """All columns of docs under numbered names, which clash with nothing, and these names."""
    names = [f"_k{i}" for i in range(len(docs.columns))]
    return [c.alias(n) for c, n in zip(every(docs), names, strict=True)], names
