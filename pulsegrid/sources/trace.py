"""Text traces to the long event table: column expressions over one scan, without a shuffle; a second scan counts the blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import ieee_div
from ..schema import EVENTS, PROCESSED_SAMPLES, SAMPLING_TIME, TSC, UNSCALED
from . import sysinfo

RULE = "=" * 10
NAN = float("nan")
DATE = r"^(\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}\.\d{3})"
#: The four events whose sum scales all perf_metrics events, and the slots they are scaled to.
TOP_DOWN = ["PERF_METRICS.RETIRING", "PERF_METRICS.BAD_SPECULATION", "PERF_METRICS.FRONTEND_BOUND", "PERF_METRICS.BACKEND_BOUND"]
SLOTS = "TOPDOWN.SLOTS:perf_metrics"


def event_device(name: Column) -> Column:
    """The device of an event by its name."""
    unit, free = F.regexp_extract(name, r"UNC_(.*?)_", 1), F.regexp_extract(name, r"FREERUN_(.*?)_", 1)
    return (F.when(name.rlike(r"UNC_(.*?)_"), F.concat(F.lit("UNC_"), unit)).when(name.rlike(r"FREERUN_(.*?)_"), free)
            .when(name.rlike(r"FREERUN:.*scope=PACKAGE"), "PACKAGE").when(F.upper(name).startswith("UNC_"), "UNCORE").otherwise("core"))


def uncore_devices(events: DataFrame) -> list[str]:
    return sorted(r[0] for r in events.where(F.col("device").startswith("UNC_")).select("device").distinct().collect())


def read_header(spark: SparkSession, path: str, ref_tsc: float | None = None, header: str | None = None) -> sysinfo.SystemInfo:
    """Read lines until the header ends; header: another file that holds it."""
    lines, n = spark.read.text(header or path), 1000
    while True:
        rows = [r[0] for r in lines.take(n)]
        if any(r.strip().startswith(sysinfo.END) for r in rows) or len(rows) < n:
            return sysinfo.parse(rows, ref_tsc)
        n *= 10


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """group (from 1) and body of every block of samples, without the header.

    A file is cut at the rule that ends a block, whatever its line ends; groups are counted by a second scan, one row for each file split.
    """
    text = spark.read.option("lineSep", RULE).text(path).withColumn("body", F.replace("value", F.lit("\r"), F.lit("")))
    text = text.withColumn("body", F.regexp_replace("body", r"(?s)^.*Version Info:[^\n]*\n", "")).where(F.col("body").rlike(r"[^\s]"))
    text = text.select("body", F.monotonically_increasing_id().alias("id"))
    part = F.shiftright("id", 33)
    counts = text.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return text.withColumn("part", part).join(F.broadcast(before), "part").select((F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int").alias("group"), "body")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """group, sample (from 0 in its block), timestamp and lines; lines before a first date don't count."""
    each = blocks(spark, path).select("group", F.posexplode_outer(F.split("body", r"\n-{10}(?:\n|$)")).alias("sample", "text"))
    date = F.regexp_extract(F.regexp_extract("text", r"(?m)" + DATE, 0), DATE, 1)
    each = each.withColumn("text", F.regexp_extract("text", r"(?sm)^(\d{2}/\d{2}/\d{4} \d{2}:.*)", 1)).withColumn("timestamp", F.try_to_timestamp(date, F.lit("MM/dd/yyyy HH:mm:ss.SSS"))).where(F.col("timestamp").isNotNull())
    return each.select("group", "sample", "timestamp", F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("\t"))).alias("lines"))


def in_range(df: DataFrame, samples_between: tuple[int, int] | None = None, times_between: tuple | None = None) -> DataFrame:
    """Samples by number (from 1, over the whole trace) or by time in whole seconds, ends included."""
    if samples_between and times_between:
        raise ValueError("give a range of samples or of times, not both")
    if times_between:
        second = F.date_trunc("second", "timestamp")
        lo, hi = (F.date_trunc("second", F.lit(t).cast("timestamp")) for t in times_between)
        return df.where(second.between(lo, hi))
    if samples_between:
        if samples_between[0] < 1 or samples_between[1] < samples_between[0]:
            raise ValueError("sample numbers begin at 1 and ascend")
        counts = df.groupBy("group").agg(F.count("*").alias("n"))
        before = counts.select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("before"))
        place = F.row_number().over(Window.partitionBy("group").orderBy("sample"))
        return df.join(before, "group").withColumn("no", F.col("before") + place).where(F.col("no").between(*samples_between)).drop("before", "no")
    return df


def lines(sampled: DataFrame) -> DataFrame:
    """group, sample, timestamp and lines (name, no, tsc, values) by name; the last line of a name in a sample counts."""
    number = lambda x: F.coalesce(F.replace(F.trim(x), F.lit(","), F.lit("")).try_cast("double"), F.lit(NAN))
    cells = F.filter(F.transform("lines", lambda x: F.split(x, "\t")), lambda c: F.size(c) > 1)
    line = lambda c, no: F.struct(
        F.trim(c[0]).alias("name"), no.alias("no"), F.replace(F.trim(c[1]), F.lit(","), F.lit("")).cast("double").alias("tsc"),
        F.transform(F.slice(c, 3, F.greatest(F.size(c) - 2, F.lit(0))), number).alias("values"))
    each = sampled.select("group", "sample", "timestamp", F.array_sort(F.transform(cells, line)).alias("all"))
    # sorted by name and number: a line counts if another name follows
    other = lambda x, i: ~F.coalesce(F.get("all", i + 1)["name"] == x["name"], F.lit(False))
    return each.select("group", "sample", "timestamp", F.filter("all", other).alias("lines"))


def rescaled(each: DataFrame) -> DataFrame:
    """perf_metrics values by the sum of the four top-down events, times slots; null without slots."""
    of = lambda *names: F.transform(F.filter("lines", lambda x: x["name"].isin(*names)), lambda x: x["values"])
    out = each.select("*", of(*TOP_DOWN).alias("parts"), F.get(of(SLOTS), F.lit(0)).alias("slots"))
    total = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.get("parts", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    out = out.withColumn("factors", F.zip_with(total, "slots", lambda t, s: F.struct(t.alias("total"), s.alias("slots"))))
    share = lambda v, f: ieee_div(v, f["total"]) * f["slots"]
    none = lambda x: F.transform(x["values"], lambda v: F.lit(None).cast("double"))
    scaled = lambda x: F.when(F.col("slots").isNotNull(), F.zip_with(x["values"], F.col("factors"), share)).otherwise(none(x))
    values = lambda x: F.when(F.lower(x["name"]).startswith("perf_metrics"), scaled(x)).otherwise(x["values"])
    return out.select(*each.columns[:-1], F.transform("lines", lambda x: x.withField("values", values(x))).alias("lines"))


def pseudo_lines(each: DataFrame, processors: int, ref_tsc: float) -> DataFrame:
    """Three more lines for each sample, with the ticks of its first line: ticks for each processor, time and number of samples."""
    tsc = F.array_min(F.transform("lines", lambda x: F.struct(x["no"], x["tsc"])))["tsc"]
    line = lambda name, values: F.struct(F.lit(name).alias("name"), F.lit(-1).alias("no"), F.col("ticks").alias("tsc"), values.alias("values"))
    more = F.array(line(TSC, F.array_repeat("ticks", processors)), line(SAMPLING_TIME, F.array(ieee_div(F.col("ticks"), F.lit(ref_tsc)))), line(PROCESSED_SAMPLES, F.array(F.lit(1.0))))
    out = each.withColumn("ticks", tsc)  # a filter here would be pushed down, with all expressions of lines
    return out.select(*each.columns[:-1], F.when(F.size("lines") > 0, F.concat("lines", more)).otherwise(F.col("lines")).alias("lines"))


def core_rows(values: Column, topology: list[dict]) -> Column:
    """A row for each processor; missing values are NaN, further ones are left out."""
    fields = ("socket", "core", "thread", "unit", "module", "device")
    cpus = F.array(*(F.struct(*(F.lit(p[k]).alias(k) for k in fields)) for p in topology))
    return F.transform(cpus, lambda p, i: F.struct(*(p[k].alias(k) for k in fields), F.when(i < F.size(values), F.get(values, i)).otherwise(F.lit(NAN)).alias("value")))


def unit_rows(values: Column, device: Column, sockets: int, name: Column) -> Column:
    """A row for each value of an uncore event: socket by socket, unit by unit."""
    n, none = F.size(values), F.lit(None).cast("int")
    ok = F.when((n >= sockets) & (n % sockets == 0), n).otherwise(F.raise_error(F.concat(F.lit("the values of "), name, F.lit(f" can't be dealt to {sockets} sockets"))).cast("int"))
    each = (ok / sockets).cast("int")
    return F.transform(values, lambda v, i: F.struct(F.floor(i / each).cast("int").alias("socket"), none.alias("core"), none.alias("thread"), (i % each).cast("int").alias("unit"), none.alias("module"), device.alias("device"), v.alias("value")))


def rows(each: DataFrame, topology: list[dict], sockets: int) -> DataFrame:
    """The long event table, with rows of null values: lines, then the values of a line, are taken apart in one pass.

    The outer kind of explode brings no inferred filter, which would evaluate the arrays once more for each of their elements.
    """
    line = each.select("timestamp", "group", F.explode_outer("lines").alias("l")).select("timestamp", "group", "l.name", "l.tsc", "l.values").withColumn("device", F.when(F.col("name").isin(*UNSCALED), "SYSTEM").otherwise(event_device(F.col("name"))))
    none = F.lit(None).cast("int")
    system = F.transform("values", lambda v: F.struct(F.lit(0).alias("socket"), none.alias("core"), none.alias("thread"), F.lit(0).alias("unit"), none.alias("module"), F.lit("SYSTEM").alias("device"), v.alias("value")))
    whole = F.when(F.col("device") == "core", core_rows(F.col("values"), topology)).when(F.col("device") == "SYSTEM", system).otherwise(unit_rows(F.col("values"), F.col("device"), sockets, F.col("name")))
    out = line.select("timestamp", "group", "name", "tsc", F.explode_outer(whole).alias("r"))
    return out.select("timestamp", "r.socket", "r.device", "r.core", "r.thread", "r.unit", "r.module", "tsc", "group", "name", "r.value")


def read_trace(spark: SparkSession, path: str, info: sysinfo.SystemInfo | None = None, *, header: str | None = None, ref_tsc: float | None = None, samples_between: tuple[int, int] | None = None, times_between: tuple | None = None) -> tuple[DataFrame, sysinfo.SystemInfo]:
    """The long event table of a trace, and what its header says."""
    info = info or read_header(spark, path, ref_tsc, header)
    if not info.ref_tsc:
        raise sysinfo.HeaderError("the time-stamp counter's frequency isn't known")
    topology = info.topology()
    if not topology:
        raise sysinfo.HeaderError("the header has no processor map")
    each = rescaled(lines(in_range(samples(spark, path), samples_between, times_between)))
    out = rows(pseudo_lines(each, len(topology), info.ref_tsc), topology, info.sockets)
    return out.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in EVENTS)).where(F.col("value").isNotNull()), info
