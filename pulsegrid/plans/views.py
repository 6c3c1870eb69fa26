"""The five views: details, aggregates, summaries and statistics of the long event table."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.numeric import col
from ..operators.reshape import distinct_values, entity, pivot
from .compute import Metric, compute_metrics


@dataclass(frozen=True)
class View:
    """What a view keeps, and the keys of its steps (group is the block number)."""

    name: str
    level: str
    mode: str  # include or exclude
    devices: tuple[str, ...]
    aggregate: tuple[str, ...]
    summary: tuple[str, ...]
    details: tuple[str, ...]
    index: tuple[str, ...]
    constants: dict[str, float] = field(default_factory=dict)
    metrics: tuple[Metric, ...] = ()

    def kept(self, df: DataFrame) -> DataFrame:
        if self.mode == "include":
            return df.where(F.col("device").isin(*self.devices))
        return df.where(~F.col("device").isin(*self.devices)) if self.devices else df


def label(device: str) -> str:
    device = device.strip('"')
    return "" if device == "core" else device.removeprefix("UNC_").lower()


def view_name(device: str, level: str, kind: str) -> str:
    own = label(device)
    return f"__edp{'_' + own if own else ''}_{level}_view_{kind}"


def make_view(level: str, device: str = "core", exclusions: tuple[str, ...] = (), modules: bool = False, constants: dict[str, float] | None = None, metrics: tuple[Metric, ...] = ()) -> View:
    m = ("module",) if modules else ()
    constants = dict(constants or {})
    name = view_name(device, level, "summary").removesuffix("_summary")
    if level == "system":
        return View(name, level, "exclude", exclusions, ("name", "socket", "unit"), ("name",), ("group", "timestamp", "tsc", "name"), ("group", "timestamp"), constants, metrics)
    if level == "socket":
        constants |= {"system.socket_count": 1.0, "SOCKET_COUNT": 1.0}
        return View(name, level, "exclude", (*exclusions, "SYSTEM"), ("name", "socket", "unit"), ("name", "socket"), ("group", "timestamp", "tsc", "name", "socket"), ("group", "timestamp", "socket"), constants, metrics)
    if level == "core":
        return View(name, level, "include", (device,), ("name", "socket", *m, "core", "unit"), ("name", "socket", *m, "core"), ("group", "timestamp", "tsc", "name", "socket", *m, "core"), ("group", "timestamp", "socket", *m, "core"), constants, metrics)
    if level == "thread":
        return View(name, level, "include", (device,), ("name", "socket", *m, "core", "thread", "unit"), ("name", "unit", "socket", *m, "core", "thread"), ("group", "timestamp", "tsc", "name", "unit", *m), ("group", "timestamp", "unit", *m), constants, metrics)
    if level == "uncore":
        constants |= {"system.socket_count": 1.0, "SOCKET_COUNT": 1.0} | {k: 1.0 for k in constants if "chas_per_socket" in k.lower()}
        return View(name, level, "include", (device,), ("name", "socket", "unit"), ("name", "unit", "socket"), ("group", "timestamp", "socket", "tsc", "name", "unit"), ("group", "timestamp", "unit", "socket"), constants, metrics)
    raise ValueError(level)


def add_views(views: list[View]) -> dict[str, View]:
    out: dict[str, View] = {}
    for v in views:
        if v.name in out:
            raise ValueError(f"two views are named {v.name!r}")
        out[v.name] = v
    return out


def keyed(keys: tuple[str, ...]) -> list[Column]:
    return [col(k) for k in keys]


def aggregate(df: DataFrame, view: View) -> DataFrame:
    """Sums of counts and ticks over all samples, by the view's finest keys."""
    return view.kept(df).groupBy(*keyed(view.aggregate)).agg(F.sum("tsc").alias("tsc"), F.sum("value").alias("value"))


def details_long(df: DataFrame, view: View, ref_tsc: float) -> DataFrame:
    """Rates of each sample, summed by the view's keys."""
    rate = N.normalized(F.col("value"), F.col("tsc"), ref_tsc, F.col("name"))
    return view.kept(df).withColumn("value", rate).groupBy(*keyed(view.details)).agg(F.sum("value").alias("value"))


def details_pivot(df: DataFrame, view: View, ref_tsc: float, names: list[str] | None = None) -> DataFrame:
    names = distinct_values(view.kept(df), "name") if names is None else names
    return pivot(details_long(df, view, ref_tsc), view.index, "name", "value", names, "mean")


def details(df: DataFrame, view: View, ref_tsc: float, names: list[str] | None = None) -> DataFrame:
    """A row for each block, sample and entity: index, metrics, events."""
    wide = details_pivot(df, view, ref_tsc, names)
    events = [c for c in wide.columns if c not in view.index]
    out, metrics = compute_metrics(wide, list(view.metrics), view.constants, list(view.index), True)
    return out.select(*keyed(view.index), *(col(m) for m in metrics), *(col(e) for e in events if e not in metrics))


def summary_long(df: DataFrame, view: View, ref_tsc: float) -> DataFrame:
    rate = N.normalized(F.col("value"), F.col("tsc"), ref_tsc, F.col("name"))
    return aggregate(df, view).withColumn("value", rate).groupBy(*keyed(view.summary)).agg(F.sum("value").alias("value"))


def device_key(view: View) -> Column:
    if view.level == "system":
        return F.lit("aggregated")
    if view.level == "socket":
        return F.col("socket").cast("string")
    if view.level == "thread":
        return F.col("unit").cast("string")
    if view.level == "uncore":
        return entity(F.col("socket"), F.col("unit"))
    return entity(*(F.col(k) for k in ("socket", "module", "core") if k in view.summary))


def summary(df: DataFrame, view: View, ref_tsc: float, names: list[str] | None = None) -> DataFrame:
    """A row for each entity: stat or Device, metrics, events."""
    names = distinct_values(view.kept(df), "name") if names is None else names
    key = "stat" if view.level == "system" else "Device"
    wide = pivot(summary_long(df, view, ref_tsc).withColumn(key, device_key(view)), [key], "name", "value", names, "first")
    out, metrics = compute_metrics(wide, list(view.metrics), view.constants)
    return out.select(col(key), *(col(m) for m in metrics), *(col(n) for n in names if n not in metrics))


STATS = ["min", "max", "95th percentile", "variation (stdev/avg)"]


def statistics(detailed: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """name, min, max, 95th percentile, variation (stdev/avg): a row for each column.

    The percentile is exact and takes two rows of each name's sorted values, so no buffer holds them all; with an accuracy it is approximate.
    """
    long = detailed.select(*(col(c).cast("double").alias(c) for c in columns)).unpivot([], [col(c) for c in columns], "name", "v")
    v = F.col("v")
    some = F.when(~F.isnan(v), v)
    head = long.groupBy("name").agg(N.nan_min(v).alias(STATS[0]), N.nan_max(v).alias(STATS[1]), *([N.p95(v, accuracy).alias(STATS[2])] if accuracy else []), N.variation(v).alias(STATS[3]), F.count(some).alias("n"))
    if not accuracy:
        at = F.lit(0.95) * (F.col("n") - 1)
        place = (F.row_number().over(Window.partitionBy("name").orderBy("v")) - 1).alias("place")
        near = long.where(some.isNotNull()).select("name", "v", place).join(head.select("name", at.alias("at")), "name").where((F.col("place") == F.floor("at")) | (F.col("place") == F.ceil("at")))
        low, high = F.min("v"), F.max("v")
        p95 = near.groupBy("name").agg((low + (high - low) * (F.max("at") - F.floor(F.max("at")))).alias(STATS[2]))
        head = head.join(p95, "name", "left")
    return head.select("name", *map(col, STATS))


def statistics_rows(detailed: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """The same, a row for each statistic."""
    long = statistics(detailed, columns, accuracy)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s).alias("stat"), col(s).alias("v")) for i, s in enumerate(STATS)))).alias("s")
    wide = pivot(long.select("name", each).select("name", "s.i", "s.stat", "s.v"), ["i", "stat"], "name", "v", columns, "first")
    return wide.orderBy("i").select("stat", *map(col, columns))


def system_summary(df: DataFrame, view: View, ref_tsc: float, accuracy: int | None = None, names: list[str] | None = None, detailed: DataFrame | None = None) -> DataFrame:
    """The system summary with its statistics below; columns that only one part has are null in the other.  detailed: the view's details, if they are at hand."""
    names = distinct_values(view.kept(df), "name") if names is None else names
    top, detailed = summary(df, view, ref_tsc, names), details(df, view, ref_tsc, names) if detailed is None else detailed
    columns = [c for c in detailed.columns if c not in view.index]
    return top.unionByName(statistics_rows(detailed, columns, accuracy), allowMissingColumns=True) if columns else top


def with_metrics(view: View, *metrics: Metric) -> View:
    return replace(view, metrics=metrics)
