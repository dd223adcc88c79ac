"""Column expressions that several operators use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once for the row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with columns named _c0, _c1 and so on, which clash with no name that an operator makes; new names by old."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def restored(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of renamed() under their own names, in their order."""
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])
