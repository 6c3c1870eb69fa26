"""Queries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formula as fm
from .functions import numeric as N
from .operators import reshape as R
from .plans import views as V
from .plans.compute import available, compute_metrics, metric
from .scratch import scratch
from .sources.trace import event_device, in_range, read_trace, uncore_devices
from .sinks.csv import ordered, write_csv
from .sinks.xlsx import table
from .sources import metrics_xml, sysinfo
from .streaming.replay import replay
from .schema import SAMPLING_TIME

REF = 2000.0
NAMES = ["click", "error", "purchase", "signup", "view"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RAW = """raw AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS timestamp, CAST(user_id % 2 AS INTEGER) AS socket,
  CASE event_type WHEN 'error' THEN 'UNC_ERR' WHEN 'signup' THEN 'SYSTEM' ELSE '"core"' END AS device,
  CAST((user_id % 8) // 2 AS INTEGER) AS core, CAST(user_id % 2 AS INTEGER) AS thread, CAST(user_id % 8 AS INTEGER) AS unit, CAST(user_id % 4 AS INTEGER) AS module,
  CAST(1000.0 + day(ts) AS DOUBLE) AS tsc, CAST(day(ts) AS INTEGER) AS grp, event_type AS name, value FROM events)"""
RATE = "CASE WHEN name = 'signup' THEN value ELSE value / tsc * 2000.0 END"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table in the shape of the long event table."""
    e, u = load(spark, sf_dir, "events"), F.col("user_id")
    day = F.dayofmonth("ts")
    device = F.when(F.col("event_type") == "error", "UNC_ERR").when(F.col("event_type") == "signup", "SYSTEM").otherwise('"core"')
    return e.select(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp"), (u % 2).cast("int").alias("socket"), device.alias("device"), F.expr("cast((user_id % 8) div 2 as int)").alias("core"),
        (u % 2).cast("int").alias("thread"), (u % 8).cast("int").alias("unit"), (u % 4).cast("int").alias("module"), (F.lit(1000.0) + day).cast("double").alias("tsc"), day.cast("int").alias("group"), F.col("event_type").alias("name"), "value")


def rate() -> F.Column:
    """As in the long event table, with signup standing for a pseudo event."""
    return N.normalized(F.col("value"), F.col("tsc"), REF, F.when(F.col("name") == "signup", SAMPLING_TIME).otherwise(F.col("name")))


def tidy(df: DataFrame) -> DataFrame:
    """group is a keyword in SQL; sums of doubles depend on their order, so they are rounded."""
    return df.select(*(F.round(N.col(c), 4).alias(c) if t == "double" else N.col(c).alias("grp" if c == "group" else c) for c, t in df.dtypes))


def query(name: str, sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


query("raw_events", f"WITH {RAW} SELECT * FROM raw")(lambda s, d: raw(s, d).withColumnRenamed("group", "grp"))
query("device_include", f"WITH {RAW} SELECT * FROM raw WHERE device IN ('UNC_ERR')")(lambda s, d: V.make_view("uncore", "UNC_ERR").kept(raw(s, d)).withColumnRenamed("group", "grp"))
query("device_exclude", f"WITH {RAW} SELECT * FROM raw WHERE device NOT IN ('SYSTEM', 'UNC_ERR')")(lambda s, d: V.make_view("system", exclusions=("SYSTEM", "UNC_ERR")).kept(raw(s, d)).withColumnRenamed("group", "grp"))
query("normalize", f"WITH {RAW} SELECT timestamp, unit, name, round({RATE}, 4) AS value FROM raw")(lambda s, d: tidy(raw(s, d).select("timestamp", "unit", "name", rate().alias("value"))))
query("sum_by_name", f"WITH {RAW} SELECT name, round(sum(value), 4) AS value FROM raw GROUP BY name")(lambda s, d: tidy(raw(s, d).groupBy("name").agg(F.sum("value").alias("value"))))


VIEWS = {"system": V.make_view("system"), "socket": V.make_view("socket", exclusions=("UNC_ERR",)), "core": V.make_view("core", '"core"', modules=True), "thread": V.make_view("thread", '"core"'), "uncore": V.make_view("uncore", "UNC_ERR")}
WHERE = {"system": "TRUE", "socket": "device NOT IN ('UNC_ERR', 'SYSTEM')", "core": "device = '\"core\"'", "thread": "device = '\"core\"'", "uncore": "device = 'UNC_ERR'"}
OF = {"system": NAMES, "socket": ["click", "purchase", "view"], "core": ["click", "purchase", "view"], "thread": ["click", "purchase", "view"], "uncore": ["error"]}
ENTITY = {"system": "'aggregated'", "socket": "CAST(socket AS VARCHAR)", "core": "concat_ws('_', socket, module, core)", "thread": "CAST(unit AS VARCHAR)", "uncore": "concat_ws('_', socket, unit)"}
PLAIN_RATE = "value / tsc * 2000.0"


def _sql_keys(keys) -> str:
    return ", ".join("grp" if k == "group" else k for k in keys)


def _register(level: str, view: V.View) -> None:
    where, names, stat = WHERE[level], OF[level], "stat" if level == "system" else "Device"
    query(f"agg_{level}", f"WITH {RAW} SELECT {_sql_keys(view.aggregate)}, round(sum(tsc), 4) AS tsc, round(sum(value), 4) AS value FROM raw WHERE {where} GROUP BY ALL")(lambda s, d: tidy(V.aggregate(raw(s, d), view)))
    long = f"SELECT {_sql_keys(view.details)}, sum({PLAIN_RATE}) AS value FROM raw WHERE {where} GROUP BY ALL"
    query(f"details_long_{level}", f"WITH {RAW}, l AS ({long}) SELECT * REPLACE (round(value, 4) AS value) FROM l")(lambda s, d: tidy(V.details_long(raw(s, d), view, REF)))
    cells = ", ".join(f"round(avg(value) FILTER (name = '{n}'), 4) AS {n}" for n in names)
    query(f"pivot_details_{level}", f"WITH {RAW}, l AS ({long}) SELECT {_sql_keys(view.index)}, {cells} FROM l GROUP BY ALL")(lambda s, d: tidy(V.details_pivot(raw(s, d), view, REF, names)))
    fine = f"SELECT {_sql_keys(view.aggregate)}, sum(tsc) AS tsc, sum(value) AS value FROM raw WHERE {where} GROUP BY ALL"
    coarse = f"SELECT {_sql_keys(view.summary)}, sum({PLAIN_RATE}) AS value FROM f GROUP BY ALL"
    ratio = ", round(max(value) FILTER (name = 'click') / max(value) FILTER (name = 'view'), 4) AS clicks_per_view" if "click" in names else ""
    cells = ", ".join(f"round(max(value) FILTER (name = '{n}'), 4) AS {n}" for n in names)
    own = V.with_metrics(view, metric("clicks_per_view", "a / b", a="click", b="view"))
    key = "" if level == "system" else f", {ENTITY[level]}"
    query(f"summary_{level}", f"WITH {RAW}, f AS ({fine}), c AS ({coarse}) SELECT {ENTITY[level]} AS {stat}{ratio}, {cells} FROM c GROUP BY {key.lstrip(', ') or 'ALL'}")(lambda s, d: tidy(V.summary(raw(s, d), own, REF, names)))


for _level, _view in VIEWS.items():
    _register(_level, _view)

WIDE = f"w AS (SELECT grp, timestamp, {', '.join(f'''avg(value) FILTER (name = '{n}') AS {n}''' for n in NAMES)} FROM (SELECT grp, timestamp, tsc, name, sum({PLAIN_RATE}) AS value FROM raw GROUP BY ALL) GROUP BY ALL)"
SAMPLE = [metric("share", "100 * click / (click + view)"), metric("gap", "[click - error, 0].max"), metric("missing", "a / b", a="click", b="absent")]


@query("metrics_sample_level", f"WITH {RAW}, {WIDE} SELECT grp, timestamp, round(100 * click / (click + view), 4) AS share, round(CASE WHEN click - error IS NULL OR click - error > 0 THEN click - error ELSE 0 END, 4) AS gap FROM w")
def metrics_sample_level(spark, sf_dir):
    out, names = compute_metrics(V.details_pivot(raw(spark, sf_dir), VIEWS["system"], REF, NAMES), SAMPLE)
    return tidy(out.select("group", "timestamp", *names))


@query("metrics_block_level", f"""WITH {RAW}, {WIDE}, o AS (SELECT grp, timestamp, CASE WHEN hour(timestamp) % 2 = 0 THEN click END AS even, CASE WHEN hour(timestamp) % 2 = 1 THEN view END AS odd FROM w),
b AS (SELECT grp, max(timestamp) AS timestamp, avg(even) / avg(odd) AS ratio FROM o GROUP BY grp)
SELECT o.grp, o.timestamp, round(b.ratio, 4) AS ratio FROM o LEFT JOIN b ON o.grp = b.grp AND o.timestamp = b.timestamp""")
def metrics_block_level(spark, sf_dir):
    wide = V.details_pivot(raw(spark, sf_dir), VIEWS["system"], REF, NAMES)
    even = F.hour("timestamp") % 2 == 0
    halves = wide.select("group", "timestamp", F.when(even, F.col("click")).alias("even"), F.when(~even, F.col("view")).alias("odd"))
    out, names = compute_metrics(halves, [metric("ratio", "even / odd")], {}, ["group", "timestamp"], True)
    return tidy(out.select("group", "timestamp", *names))


def _formula(name: str, text: str, sql: str) -> None:
    """A formula over lineitem: q quantity, p price, d discount, t tax."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cols = {"q": "l_quantity", "p": "l_extendedprice", "d": "l_discount", "t": "l_tax"}
        return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fm.compile_formula(text, lambda x: F.col(cols[x])).cast("double").alias("v"))

    query(f"formula_{name}", f"SELECT l_orderkey, l_linenumber, CAST({sql} AS DOUBLE) AS v FROM (SELECT *, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t FROM lineitem)")(run)


for _name, _text, _sql in [
    ("add", "q + t", "q + t"), ("sub", "p - q", "p - q"), ("mul", "q * d", "q * d"), ("div", "p / q", "p / q"), ("floordiv", "p // q", "floor(p / q)"), ("pow", "q ** 2", "q ** 2"),
    ("and", "q & 12", "CAST(q AS BIGINT) & 12"), ("or", "q | 12", "CAST(q AS BIGINT) | 12"), ("xor", "q ^ 12", "xor(CAST(q AS BIGINT), 12)"), ("neg", "-q * 2", "-q * 2"),
    ("max", "[q, 25].max", "CASE WHEN q > 25 THEN q ELSE 25 END"), ("min", "[q, 25].min", "CASE WHEN q < 25 THEN q ELSE 25 END"), ("ternary", "(q > 25) ? p : d", "CASE WHEN q > 25 THEN p ELSE d END"),
    ("precedence", "q + t * 2 ** 3 - p / {q - 60} // 2", "q + t * 2 ** 3 - floor((p / (q - 60)) / 2)"), ("index", "q[0] + 1", "q + 1"),
]:
    _formula(_name, _text, _sql)


@query("formula_div_zero", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN CASE WHEN l_tax = 0 THEN 'nan' ELSE 'inf' END ELSE 'number' END AS kind FROM lineitem")
def formula_div_zero(spark, sf_dir):
    q = fm.compile_formula("l_tax / l_discount")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.isnan(q), "nan").when(q == N.INF, "inf").otherwise("number").alias("kind"))


@query("formula_null_max", "SELECT l_orderkey, l_linenumber, CASE WHEN x IS NULL OR x > l_tax THEN x ELSE l_tax END AS v FROM (SELECT *, CASE WHEN l_linenumber > 2 THEN l_discount END AS x FROM lineitem)")
def formula_null_max(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").withColumn("x", F.when(F.col("l_linenumber") > 2, F.col("l_discount")))
    return x.select("l_orderkey", "l_linenumber", fm.compile_formula("[x, l_tax].max").alias("v"))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.statistics(V.details_pivot(raw(spark, sf_dir), VIEWS["system"], REF, NAMES), NAMES)


LONG = f"{RAW}, {WIDE}, u AS (UNPIVOT w ON {', '.join(NAMES)} INTO NAME name VALUE v)"
STAT_SQL = {"min": "min(v)", "max": "max(v)", "95th percentile": "quantile_cont(v, 0.95)", "variation (stdev/avg)": "CASE WHEN count(v) < 2 THEN 0 ELSE stddev_pop(v) / avg(v) END"}


def _stat_query(name: str, wanted: list[str]) -> None:
    columns = ", ".join(f'round({STAT_SQL[w]}, 4) AS "{w}"' for w in wanted)
    query(name, f"WITH {LONG} SELECT name, {columns} FROM u GROUP BY name")(lambda s, d: tidy(_stats(s, d).select("name", *map(N.col, wanted))))


for _name, _wanted in (("stats_minmax", V.STATS[:2]), ("stats_p95", V.STATS[2:3]), ("stats_variation", V.STATS[3:]), ("stats_all", V.STATS)):
    _stat_query(_name, _wanted)

query("system_summary_with_stats", f"""WITH {LONG}, f AS (SELECT name, socket, unit, sum(tsc) AS tsc, sum(value) AS value FROM raw GROUP BY ALL), c AS (SELECT name, sum({PLAIN_RATE}) AS v FROM f GROUP BY name),
s AS (SELECT 'aggregated' AS stat, name, v FROM c {' '.join(f"UNION ALL SELECT '{k}', name, {v} FROM u GROUP BY name" for k, v in STAT_SQL.items())})
SELECT stat, {', '.join(f"round(max(v) FILTER (name = '{n}'), 4) AS {n}" for n in NAMES)} FROM s GROUP BY stat""")(lambda s, d: tidy(V.system_summary(raw(s, d), VIEWS["system"], REF)))


@query("join_left", "SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def join_left(spark, sf_dir):
    rich = load(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(rich, orders.o_custkey == rich.c_custkey, "left").drop("c_custkey")


HALF = "timestamp '1995-01-01'"


@query("join_outer_merge", f"""WITH a AS (SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS v FROM orders WHERE o_orderdate < {HALF} GROUP BY ALL), b AS (SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS v FROM orders WHERE o_orderdate >= {HALF} GROUP BY ALL)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, round(coalesce(a.v, 0) + coalesce(b.v, 0), 2) AS v FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority""")
def join_outer_merge(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.col("o_totalprice").alias("v"), (F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")).alias("old"))
    out = R.merge_sums(orders.where("old"), orders.where("not old"), ["o_custkey", "o_orderpriority"], ["v"])
    return out.select("o_custkey", "o_orderpriority", F.round("v", 2).alias("v"))


query("union_align", "SELECT c_name AS name, c_acctbal AS balance, -1::BIGINT AS s_suppkey FROM customer UNION ALL SELECT s_name, NULL, s_suppkey FROM supplier")(
    lambda s, d: R.union_aligned([load(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), load(s, d, "supplier").select(F.col("s_name").alias("name"), "s_suppkey")]).fillna(-1, ["s_suppkey"]))


@query("transpose", """SELECT 'lines' AS measure, count(*) FILTER (l_returnflag = 'A') AS "A", count(*) FILTER (l_returnflag = 'N') AS "N", count(*) FILTER (l_returnflag = 'R') AS "R" FROM lineitem
UNION ALL SELECT 'orders', count(DISTINCT l_orderkey) FILTER (l_returnflag = 'A'), count(DISTINCT l_orderkey) FILTER (l_returnflag = 'N'), count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') FROM lineitem""")
def transpose(spark, sf_dir):
    return R.transpose(load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("lines"), F.countDistinct("l_orderkey").alias("orders")), "measure", "l_returnflag")


query("entity_key", f"WITH {RAW} SELECT DISTINCT concat_ws('_', socket, CASE WHEN unit > 3 THEN module END, core) AS entity FROM raw")(
    lambda s, d: raw(s, d).select(R.entity(F.col("socket"), F.when(F.col("unit") > 3, F.col("module")), F.col("core")).alias("entity")).distinct())
query("sort_csv_order", f"WITH {RAW} SELECT grp, timestamp, unit, round(sum(value), 4) AS value FROM raw GROUP BY ALL ORDER BY grp, timestamp, unit")(
    lambda s, d: tidy(ordered(raw(s, d).groupBy("group", "timestamp", "unit").agg(F.sum("value").alias("value")))))
query("distinct_devices", f"WITH {RAW} SELECT DISTINCT device FROM raw WHERE device LIKE 'UNC!_%' ESCAPE '!'")(
    lambda s, d: s.createDataFrame([(x,) for x in uncore_devices(raw(s, d))], "device string"))

RULE_NAMES = ["UNC_CHA_CLOCKTICKS", "unc_misc", "X_FREERUN_MEM_READ", "FREERUN:a:scope=PACKAGE", "INST_RETIRED.ANY", "UNC_M_CAS"]


@query("event_device_rule", f"""SELECT name, CASE WHEN regexp_matches(name, 'UNC_(.*?)_') THEN 'UNC_' || regexp_extract(name, 'UNC_(.*?)_', 1) WHEN regexp_matches(name, 'FREERUN_(.*?)_') THEN regexp_extract(name, 'FREERUN_(.*?)_', 1)
WHEN regexp_matches(name, 'FREERUN:.*scope=PACKAGE') THEN 'PACKAGE' WHEN starts_with(upper(name), 'UNC_') THEN 'UNCORE' ELSE 'core' END AS device FROM (SELECT unnest({RULE_NAMES}) AS name UNION SELECT event_type FROM events)""")
def event_device_rule(spark, sf_dir):
    listed = spark.createDataFrame([(n,) for n in RULE_NAMES], "name string")
    return listed.union(load(spark, sf_dir, "events").select("event_type")).distinct().select("name", event_device(F.col("name")).alias("device"))


query("sample_range", f"WITH {RAW} SELECT * FROM raw WHERE timestamp BETWEEN timestamp '2024-01-03 05:00:00' AND timestamp '2024-01-04 07:00:00'")(
    lambda s, d: in_range(raw(s, d), times_between=("2024-01-03 05:00:00", "2024-01-04 07:00:00")).withColumnRenamed("group", "grp"))


#: The events as a text trace: days are blocks, hours are samples, users are dealt to four processors in two sockets.
TRACE_HEAD = ["TSC Freq ............. 2000.00 MHz", "OS Processor\tPhys. Package\tCore\tLogical Processor", *(f"{i}\t{i // 2}\t{i // 2}\t{i % 2}" for i in range(4)), sysinfo.RULE, "Version Info: events"]
TRACE_NAMES = {"click": "INST_RETIRED.ANY", "purchase": "TOPDOWN.SLOTS:perf_metrics", "view": "PERF_METRICS.RETIRING", "signup": "PERF_METRICS.BAD_SPECULATION", "error": "UNC_CHA_HITS"}


def write_trace(spark: SparkSession, sf_dir: str) -> str:
    """Write the trace to the shared folder and return its path; every sample has a line that a later one of its name replaces."""
    path = scratch(spark, "trace")
    name = F.create_map(*(F.lit(x) for pair in TRACE_NAMES.items() for x in pair))
    e = load(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("hour"), name[F.col("event_type")].alias("name"), (F.col("user_id") % 4).cast("int").alias("cpu"), F.floor("value").alias("n"))
    cells = F.concat_ws("\t", *(F.coalesce(F.sum(F.when(F.col("cpu") == i, F.col("n"))), F.lit(0)) + 1 for i in range(4)))
    tsc = F.format_number(F.lit(2_000_000_000) + F.hour("hour") * 1000, 0)
    text = e.groupBy("hour", "name").agg(cells.alias("cells")).select("hour", F.concat_ws("\t", "name", tsc, "cells").alias("line"), F.concat_ws("\t", "name", tsc, F.lit("7")).alias("replaced"))
    text = text.groupBy("hour").agg(F.concat_ws("\n", F.date_format("hour", "MM/dd/yyyy HH:mm:ss.SSS"), F.max("replaced"), F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("-" * 10)).alias("sample"))
    days = text.groupBy(F.to_date("hour").alias("day")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hour", "sample"))), lambda x: x["sample"]), "\n").alias("block"))
    days.orderBy("day").select(F.concat("block", F.lit("\n" + "=" * 10))).coalesce(1).write.text(path)
    return path


def trace(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return read_trace(spark, write_trace(spark, sf_dir), sysinfo.parse(TRACE_HEAD), **how)[0].withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


TRACE = """e AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS timestamp, event_type AS t, user_id % 4 AS cpu, floor(value) AS n FROM events),
l AS (SELECT timestamp, t, cpu, coalesce((SELECT sum(n) FROM e WHERE e.timestamp = k.timestamp AND e.t = k.t AND e.cpu = c.cpu), 0) + 1 AS v FROM (SELECT DISTINCT timestamp, t FROM e) k, (SELECT unnest([0, 1, 2, 3]) AS cpu) c),
m AS (SELECT l.*, sum(v) FILTER (t IN ('view', 'signup')) OVER w AS part, max(v) FILTER (t = 'purchase') OVER w AS slots FROM l WINDOW w AS (PARTITION BY timestamp, cpu)),
b AS (SELECT timestamp, 2e9 + 1000 * hour(timestamp) AS tsc, CAST(dense_rank() OVER (ORDER BY date_trunc('day', timestamp)) AS INTEGER) AS grp, CAST(row_number() OVER (ORDER BY timestamp) AS INTEGER) AS no FROM (SELECT DISTINCT timestamp FROM e)),
trace AS (SELECT timestamp, CAST(cpu // 2 AS INTEGER) AS socket, 'core' AS device, CAST(cpu // 2 AS INTEGER) AS core, CAST(cpu % 2 AS INTEGER) AS thread, CAST(cpu AS INTEGER) AS unit, 0 AS module,
  CASE t """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TRACE_NAMES.items()) + """ END AS name, CAST(CASE WHEN t IN ('view', 'signup') THEN v / CAST(part AS DOUBLE) * slots ELSE v END AS DOUBLE) AS value FROM m WHERE t <> 'error' AND (slots IS NOT NULL OR t NOT IN ('view', 'signup'))
UNION ALL SELECT timestamp, CAST(cpu // 2 AS INTEGER), 'UNC_CHA', NULL, NULL, CAST(cpu % 2 AS INTEGER), NULL, 'UNC_CHA_HITS', CAST(v AS DOUBLE) FROM m WHERE t = 'error'
UNION ALL SELECT timestamp, CAST(cpu // 2 AS INTEGER), 'core', CAST(cpu // 2 AS INTEGER), CAST(cpu % 2 AS INTEGER), CAST(cpu AS INTEGER), 0, 'TSC', tsc FROM b, (SELECT unnest([0, 1, 2, 3]) AS cpu)
UNION ALL SELECT timestamp, 0, 'SYSTEM', NULL, NULL, 0, NULL, '$samplingTime', tsc / 2e9 FROM b
UNION ALL SELECT timestamp, 0, 'SYSTEM', NULL, NULL, 0, NULL, '$processed_samples', 1.0 FROM b),
rows AS (SELECT trace.*, b.tsc, b.grp, b.no FROM trace JOIN b USING (timestamp))"""
query("trace_rows", f"WITH {TRACE} SELECT * EXCLUDE (no) REPLACE (coalesce(core, -1) AS core, coalesce(thread, -1) AS thread, coalesce(module, -1) AS module) FROM rows")(lambda s, d: trace(s, d).withColumnRenamed("group", "grp").fillna(-1, ["core", "thread", "module"]))
query("trace_samples_between", f"WITH {TRACE} SELECT * EXCLUDE (no) REPLACE (coalesce(core, -1) AS core, coalesce(thread, -1) AS thread, coalesce(module, -1) AS module) FROM rows WHERE no BETWEEN 20 AND 60")(lambda s, d: trace(s, d, samples_between=(20, 60)).withColumnRenamed("group", "grp").fillna(-1, ["core", "thread", "module"]))
query("trace_times_between", f"WITH {TRACE} SELECT * EXCLUDE (no) REPLACE (coalesce(core, -1) AS core, coalesce(thread, -1) AS thread, coalesce(module, -1) AS module) FROM rows WHERE timestamp BETWEEN timestamp '2024-01-03 05:00:00' AND timestamp '2024-01-04 07:00:00'")(
    lambda s, d: trace(s, d, times_between=("2024-01-03 05:00:00", "2024-01-04 07:00:00")).withColumnRenamed("group", "grp").fillna(-1, ["core", "thread", "module"]))
query("topdown_rescale", f"WITH {TRACE} SELECT grp, timestamp, unit, name, value FROM rows WHERE starts_with(name, 'PERF_METRICS')")(
    lambda s, d: trace(s, d).where(F.col("name").startswith("PERF_METRICS")).select(F.col("group").alias("grp"), "timestamp", "unit", "name", "value"))
query("processor_lookup", f"WITH {TRACE} SELECT DISTINCT unit, socket, core, thread, module FROM rows WHERE device = 'core'")(
    lambda s, d: trace(s, d).where("device = 'core'").select("unit", "socket", "core", "thread", "module").distinct())
TRACE_VIEW = V.with_metrics(V.make_view("socket"), metric("useful", "100 * a / b", a="PERF_METRICS.RETIRING", b="TOPDOWN.SLOTS:perf_metrics"))


@query("trace_details_csv", f"""WITH {TRACE}, d AS (SELECT grp, timestamp, socket, name, sum(value / tsc * 2e9) AS v FROM rows WHERE device <> 'SYSTEM' GROUP BY ALL)
SELECT grp, timestamp, socket, round(100 * max(v) FILTER (name = 'PERF_METRICS.RETIRING') / max(v) FILTER (name = 'TOPDOWN.SLOTS:perf_metrics'), 4) AS useful, round(max(v) FILTER (name = 'UNC_CHA_HITS'), 4) AS hits FROM d GROUP BY ALL""")
def trace_details_csv(spark, sf_dir):
    """Through the sink and back: a folder of CSV files, so that nothing passes the driver."""
    path = scratch(spark, "details")
    write_csv(V.details(trace(spark, sf_dir), TRACE_VIEW, 2e9), path, single_file=False)
    back = spark.read.option("header", True).csv(path)
    number = lambda c: F.round(N.col(c).cast("double"), 4)
    return back.select(F.col("group").cast("int").alias("grp"), F.to_timestamp_ntz("timestamp").alias("timestamp"), F.col("socket").cast("int").alias("socket"), number("useful").alias("useful"), number("UNC_CHA_HITS").alias("hits"))


INFO = sysinfo.parse(TRACE_HEAD)
query("header_processors", "SELECT i AS unit, i // 2 AS socket, i // 2 AS core, i % 2 AS thread FROM range(4) r(i)")(
    lambda s, d: s.createDataFrame([(p["unit"], p["socket"], p["core"], p["thread"]) for p in INFO.topology()], "unit long, socket long, core long, thread long"))
query("header_symbols", "SELECT * FROM (VALUES ('SYSTEM_TSC_FREQ', 2e9::DOUBLE), ('SOCKET_COUNT', 2.0), ('CORES_PER_SOCKET', 1.0), ('THREADS_PER_SOCKET', 2.0), ('THREADS_PER_CORE', 1.0)) t(name, value)")(
    lambda s, d: s.createDataFrame([(k, INFO.symbols()[k]) for k in ("SYSTEM_TSC_FREQ", "SOCKET_COUNT", "CORES_PER_SOCKET", "THREADS_PER_SOCKET", "THREADS_PER_CORE")], "name string, value double"))
XML = """<root><metric name="reuse"><event alias="a">click</event><event alias="b">view</event><constant alias="k">2</constant><formula>a / b * k</formula><formula socket="0">a</formula><description>by view</description></metric>
<metric name="late"><event alias="a">click:retire_latency</event><formula>a</formula></metric><metric name="empty"><event alias="a">click</event></metric></root>"""


@query("metric_definitions", "SELECT * FROM (VALUES ('reuse', 'a/b*k', 'a=click,b=view', 'k=2', '', 'by view', true), ('late', 'a', '', '', 'a=click:retire_latency', NULL, false)) t(name, formula, events, constants, latencies, description, known)")
def metric_definitions(spark, sf_dir):
    pairs = lambda x: ",".join(f"{k}={v}" for k, v in sorted(x.items()))
    rows = [(m.name, m.formula, pairs(m.events), pairs(m.constants), pairs(m.latencies), m.description, available(m, set(NAMES))) for m in metrics_xml.parse(XML)]
    return spark.createDataFrame(rows, "name string, formula string, events string, constants string, latencies string, description string, known boolean")


@query("metric_from_xml", f"WITH {RAW}, {WIDE} SELECT grp, timestamp, round(click / view * 2, 4) AS reuse FROM w")
def metric_from_xml(spark, sf_dir):
    out, names = compute_metrics(V.details_pivot(raw(spark, sf_dir), VIEWS["system"], REF, NAMES), metrics_xml.parse(XML))
    return tidy(out.select("group", "timestamp", *names))


LEVELS = ["system", "socket", "core", "thread", "uncore"]
query("view_names", f"SELECT level, device, '__edp_' || CASE device WHEN '\"core\"' THEN '' ELSE lower(substr(device, 5)) || '_' END || level || '_view_details' AS name FROM (SELECT unnest({LEVELS}) AS level), (SELECT DISTINCT device FROM (SELECT CASE event_type WHEN 'error' THEN 'UNC_ERR' ELSE '\"core\"' END AS device FROM events))")(
    lambda s, d: s.createDataFrame([(v, x["device"], V.view_name(x["device"], v, "details")) for x in raw(s, d).where("device <> 'SYSTEM'").select("device").distinct().collect() for v in LEVELS], "level string, device string, name string"))


@query("summary_sheet", f"""WITH {RAW}, f AS (SELECT name, socket, unit, sum(tsc) AS tsc, sum(value) AS value FROM raw WHERE device NOT IN ('UNC_ERR', 'SYSTEM') GROUP BY ALL), c AS (SELECT name, socket, sum({PLAIN_RATE}) AS v FROM f GROUP BY ALL)
SELECT name, round(max(v) FILTER (socket = 0), 4) AS "Socket 0", round(max(v) FILTER (socket = 1), 4) AS "Socket 1" FROM c GROUP BY name""")
def summary_sheet(spark, sf_dir):
    """The rows of a worksheet: events down, entities across."""
    head, *rows = table(V.summary(raw(spark, sf_dir), VIEWS["socket"], REF, OF["socket"]), "socket")
    return tidy(spark.createDataFrame(rows, "name string, " + ", ".join(f"`{h}` double" for h in head[1:])))


query("stream_sums", f"WITH {RAW} SELECT name, socket, unit, round(sum(tsc), 4) AS tsc, round(sum(value), 4) AS value FROM raw GROUP BY ALL")(lambda s, d: stream_sums(s, d))


def stream_sums(spark, sf_dir):
    """The running sums after a stream of the events has been replayed."""
    path, out = scratch(spark, "stream"), scratch(spark, "sums")
    raw(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp")).write.parquet(path)
    last: list[str] = []

    def each(sums: DataFrame, batch: int) -> None:
        last.append(f"{out}/{batch}")
        sums.write.mode("overwrite").parquet(last[-1])

    running = replay(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), VIEWS["system"], each, "0 seconds")
    running.processAllAvailable()
    running.stop()
    return tidy(spark.read.parquet(last[-1]))


@query("pivot_aggregates", """SELECT l_linestatus, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 4) AS "sum A", round(sum(l_quantity) FILTER (l_returnflag = 'N'), 4) AS "sum N", round(sum(l_quantity) FILTER (l_returnflag = 'R'), 4) AS "sum R",
round(median(l_tax) FILTER (l_returnflag = 'A'), 4) AS "median A", round(median(l_tax) FILTER (l_returnflag = 'N'), 4) AS "median N", round(median(l_tax) FILTER (l_returnflag = 'R'), 4) AS "median R",
count(l_tax) FILTER (l_returnflag = 'A') AS "count A", count(l_tax) FILTER (l_returnflag = 'N') AS "count N", count(l_tax) FILTER (l_returnflag = 'R') AS "count R" FROM lineitem GROUP BY l_linestatus""")
def pivot_aggregates(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem")
    out = None
    for how, value in (("sum", "l_quantity"), ("median", "l_tax"), ("count", "l_tax")):
        wide = R.pivot(line, ["l_linestatus"], "l_returnflag", value, ["A", "N", "R"], how).select("l_linestatus", *(F.col(c).alias(f"{how} {c}") for c in "ANR"))
        out = wide if out is None else out.join(wide, "l_linestatus")
    return tidy(out).select("l_linestatus", *(F.coalesce(N.col(c), F.lit(0)).alias(c) if c.startswith("count") else N.col(c) for c in out.columns[1:]))
