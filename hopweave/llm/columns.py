"""Columns of the caller beside columns that an operator makes on the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_other_names(df: DataFrame, taken: set[str], text: str, run: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """run over df and the name of its text column; columns of ``taken`` names (lower case) go by others meanwhile."""
    used, back = {c.lower() for c in df.columns} | taken, {}
    for name in df.columns:
        if name.lower() in taken:
            other = next(x for i in range(len(used) + 1) if (x := f"own_{i}") not in used)
            used.add(other)
            back[other] = name
    there = {v: k for k, v in back.items()}
    return run(df.withColumnsRenamed(there), there.get(text, text)).withColumnsRenamed(back)


def as_row(df: DataFrame, *more: Column) -> DataFrame:
    """All columns as one struct ``row``, and more columns beside it, whose names cannot clash with those inside."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), *more)


def from_row(df: DataFrame, names: list[str], **instead: Column) -> DataFrame:
    """The columns of the struct ``row``, some replaced."""
    return df.select(*[instead[c].alias(c) if c in instead else F.col("row")[c].alias(c) for c in names])
