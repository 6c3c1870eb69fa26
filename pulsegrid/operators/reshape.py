"""Pivot, transpose and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col

AGGREGATES = {"first": F.first, "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "median": F.median, "count": F.count, "last": F.last}


def distinct_values(df: DataFrame, column: str) -> list:
    """The sorted distinct values of a column of names."""
    return sorted(r[0] for r in df.select(col(column)).distinct().collect() if r[0] is not None)


def pivot(df: DataFrame, index: Sequence[str], column: str | Sequence[str], value: str | Sequence[str], names: Sequence | None = None, how: str = "mean", separator: str = "_") -> DataFrame:
    """One row for each index, one column for each name; gaps are null.

    Several columns form one name joined by the separator; several values give
    columns named value, column and name.
    """
    columns = [column] if isinstance(column, str) else list(column)
    values = [value] if isinstance(value, str) else list(value)
    key = "pivot key"
    df = df.withColumn(key, F.concat_ws(separator, *map(col, columns)) if len(columns) > 1 else F.coalesce(col(columns[0]).cast("string"), F.lit("null")))
    names = distinct_values(df, key) if names is None else list(names)
    keys = [col(c) for c in index]
    if not names:
        return df.select(*keys).distinct()
    wide = df.groupBy(*keys).pivot(key, names).agg(*(AGGREGATES[how](col(v)).alias(f"v{i}") for i, v in enumerate(values)))
    if len(values) == 1:
        return wide
    return wide.select(*keys, *(col(f"{n}_v{i}").alias(separator.join([v, *columns, str(n)])) for i, v in enumerate(values) for n in names))


def transpose(df: DataFrame, keep_names_as: str, new_names: str | Sequence[str] | None = None) -> DataFrame:
    """Columns become rows.  New columns are named by a column, a list, or column_0, column_1, ... ; for frames of display size."""
    if isinstance(new_names, str):
        rows = df.count()
        heads = [r[0] for r in df.select(col(new_names)).collect()]
        if any(h is None for h in heads) or len(set(heads)) < rows or keep_names_as in heads:
            raise ValueError(f"{new_names!r} doesn't name new columns")
        body = [c for c in df.columns if c != new_names]
    else:
        body, rows = list(df.columns), df.count()
        heads = list(new_names) if new_names is not None else [f"column_{i}" for i in range(rows)]
    if not rows or not body:
        raise ValueError("nothing to transpose")
    if len(heads) != rows:
        raise ValueError(f"{rows} names are needed")
    data = [r.asDict() for r in df.collect()]
    kind = reduce(lambda a, b: a if a == b else "string", {t for c, t in df.dtypes if c in body})
    cast = {"double": float, "float": float, "int": int, "bigint": int}.get(kind, str)
    cells = [[c, *(None if r[c] is None else cast(r[c]) for r in data)] for c in body]
    return df.sparkSession.createDataFrame(cells, f"`{keep_names_as}` string, " + ", ".join(f"`{str(h).replace('`', '``')}` {kind}" for h in heads))


def union_aligned(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_sums(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A running sum with new rows added by key."""
    return old.select(*keys, *values).unionByName(new.select(*keys, *values)).groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))


def entity(*keys: Column) -> Column:
    """Keys joined by underscores; null ones are left out."""
    return F.concat_ws("_", *keys)
