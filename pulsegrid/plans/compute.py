"""Metrics over a wide event frame, with block-level values where no sample has one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formula as fm
from ..functions.numeric import col


@dataclass(frozen=True)
class Metric:
    name: str
    formula: str
    events: dict[str, str] = field(default_factory=dict)
    constants: dict[str, str] = field(default_factory=dict)
    latencies: dict[str, str] = field(default_factory=dict)
    throughput_name: str | None = None
    description: str | None = None


def metric(name: str, formula: str, **events: str) -> Metric:
    return Metric(name, formula.replace(" ", ""), events)


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def available(m: Metric, columns: set[str]) -> bool:
    """Whether all events, constants and latencies of a metric are there; the formula language can't use latencies."""
    return not m.latencies and set(m.events.values()) <= columns and all(_number(c) is not None or c in columns for c in m.constants.values())


def metric_column(m: Metric, constants: dict[str, float], columns: set[str]) -> Column:
    def value(name: str) -> Column:
        return F.lit(float(constants[name])) if name in constants else col(name)

    def resolve(alias: str) -> Column:
        if alias in m.events:
            return value(m.events[alias])
        if alias in m.constants:
            text = m.constants[alias]
            return value(text) if text in columns or text in constants else F.lit(float(text))
        if alias in columns or alias in constants:
            return value(alias)
        raise fm.FormulaError(f"{alias!r} in the formula of {m.name!r} isn't known")

    return fm.compile_formula(m.formula, resolve).cast("double")


def compute_metrics(df: DataFrame, metrics: list[Metric], constants: dict[str, float] | None = None, index: list[str] | None = None, block_level: bool = False) -> tuple[DataFrame, list[str]]:
    """df with a column for each metric whose inputs exist, and these metrics' names.

    With block_level, metrics that are null in all rows are computed anew from
    the block means of their inputs (index without its second column, the
    timestamp) and appear in the rows of each block's last timestamp.
    """
    constants = constants or {}
    columns = set(df.columns) | set(constants)
    known = [m for m in {m.name: m for m in metrics}.values() if available(m, columns)]
    exprs = {m.name: metric_column(m, constants, columns) for m in known}
    if not block_level or not known:
        return df.select("*", *(e.alias(n) for n, e in exprs.items())), [m.name for m in known]
    # one row of counts beside every row, and the block means, in the same plan: the frame's shuffle is shared by all three
    counts = df.agg(*(F.count(e).alias(f"count {i}") for i, e in enumerate(exprs.values())))
    block = [index[0], *index[2:]]
    floats = [c for c, t in df.dtypes if t in ("double", "float") and c not in index]
    means = df.groupBy(*map(col, block)).agg(F.max(col(index[1])).alias(index[1]), *(F.avg(col(c)).alias(c) for c in floats))
    means = means.select(*map(col, index), *(e.alias(f"block {n}") for n, e in exprs.items()))
    wide = df.join(means, index, "left").join(F.broadcast(counts))
    either = [F.when(col(f"count {i}") == 0, col(f"block {n}")).otherwise(e).alias(n) for i, (n, e) in enumerate(exprs.items())]
    return wide.select(*(col(c) for c in df.columns), *either), [m.name for m in known]
