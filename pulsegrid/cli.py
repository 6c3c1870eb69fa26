"""python -m pulsegrid.cli parse TRACE --xml METRICS [-s] [-c] [-t] [-u] [-n] [--out FOLDER]"""

from __future__ import annotations

import argparse
import os
import time

from pyspark import StorageLevel
from pyspark.sql import SparkSession

from .plans import views as V
from .sinks.csv import write_csv
from .sinks.xlsx import table, write_xlsx
from .sources import metrics_xml
from .sources.trace import read_trace, uncore_devices


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="pulsegrid")
    one = p.add_subparsers(dest="command", required=True).add_parser("parse")
    one.add_argument("trace")
    one.add_argument("-x", "--xml", required=True)
    for short, name in (("s", "socket"), ("c", "core"), ("t", "thread"), ("u", "uncore")):
        one.add_argument(f"-{short}", f"--{name}", f"--{name}-view", dest=name, action="store_true")
    one.add_argument("-n", "--no-details", action="store_true")
    one.add_argument("-m", "--memory-saver", "--mem", dest="memory_saver", action="store_true", help="write details as folders, unsorted")
    one.add_argument("--chunk-size", type=int, help="bytes of a file split")
    one.add_argument("--time-zone", default="UTC", help="of the trace's dates")
    one.add_argument("--out", default=".")
    return p.parse_args(argv)


def plan(info, uncore: list[str], wanted: argparse.Namespace, metrics: tuple) -> list[V.View]:
    """System first, then the asked-for views; core and thread views for each core type."""
    symbols = info.symbols()
    make = lambda level, device="core": V.make_view(level, device, (), info.modules, symbols, metrics)
    out = [make("system")] + [make("socket")] * wanted.socket
    for device in info.core_types:
        out += [make(level, device) for level in ("core", "thread") if getattr(wanted, level)]
    return out + [make("uncore", d) for d in uncore if wanted.uncore]


def run(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    if a.chunk_size:
        spark.conf.set("spark.sql.files.maxPartitionBytes", a.chunk_size)
    events, info = read_trace(spark, a.trace)
    events = events.persist(StorageLevel.MEMORY_AND_DISK)
    metrics = tuple(metrics_xml.read(a.xml))
    views = V.add_views(plan(info, uncore_devices(events) if a.uncore else [], a, metrics))
    os.makedirs(a.out, exist_ok=True)
    sheets, files = {}, []
    for name, view in views.items():
        names = V.distinct_values(view.kept(events), "name")
        detailed = V.details(events, view, info.ref_tsc, names)
        if view.level == "system":  # read for its statistics and for its file
            detailed = detailed.persist(StorageLevel.MEMORY_AND_DISK)
            top = V.system_summary(events, view, info.ref_tsc, names=names, detailed=detailed)
        else:
            top = V.summary(events, view, info.ref_tsc, names)
        sheets[name + "_summary"] = table(top, view.level, info.modules)
        if not a.no_details:
            files.append(os.path.join(a.out, f"{name}_details.csv"))
            write_csv(detailed, files[-1], single_file=not a.memory_saver, sort=not a.memory_saver)
        detailed.unpersist()
    files.append(os.path.join(a.out, "summary.xlsx"))
    write_xlsx(files[-1], sheets)
    events.unpersist()
    return files


def main(argv: list[str] | None = None) -> None:
    a, began = arguments(argv), time.time()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", a.time_zone).getOrCreate()
    for f in run(spark, a):
        print(f)
    print(f"{time.time() - began:.2f} s")


if __name__ == "__main__":
    main()
