"""A view's details as one named CSV file, or as a folder at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.numeric import col

ORDERS = [("group", "timestamp", "socket", "core"), ("group", "timestamp", "socket"), ("group", "timestamp", "unit"), ("group", "timestamp")]


def ordered(df: DataFrame) -> DataFrame:
    """Rows by the first prefix of index columns that the frame has."""
    keys = next((k for k in ORDERS if set(k) <= set(df.columns)), ())
    return df.orderBy(*map(col, keys)) if keys else df


def write_csv(df: DataFrame, path: str, single_file: bool = True, sort: bool = True) -> None:
    df = ordered(df) if sort else df
    if not single_file:
        df.write.mode("overwrite").option("header", True).csv(path)
        return
    import csv

    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator(prefetchPartitions=True):  # a partition at a time
            out.writerow(["" if v is None else v for v in row])
