"""Times `parse` end to end on generated traces: 256 processors, 45 events a second, one second a sample."""

from __future__ import annotations

import os
import random
import sys
import tempfile
import time

PROCESSORS, CORE_EVENTS, UNIT_EVENTS, SECONDS_A_BLOCK = 256, 40, 5, 5


def header() -> str:
    rule = "-" * 41
    rows = "\n".join(f"{i}\t{i % 128 // 64}\t{i % 64}\t{i // 128}" for i in range(PROCESSORS))
    return f"TSC Freq ............. 2000.00 MHz\n{rule}\nOS Processor\tPhys. Package\tCore\tLogical Processor\n{rule}\n{rows}\n{rule}\n\nVersion Info: bench\n"


def write_trace(path: str, megabytes: float) -> None:
    """Samples until the file has its size; blocks take turns in which core events they hold."""
    r, sizes, sample = random.Random(3), 0, 0
    values = ["\t".join(f"{r.randrange(10**6, 10**9):,}" for _ in range(PROCESSORS)) for _ in range(200)]
    with open(path, "w", encoding="utf-8") as f:
        sizes += f.write(header())
        while sizes < megabytes * 1e6:
            second = time.strftime("%m/%d/%Y %H:%M:%S.000", time.gmtime(1.7e9 + sample))
            lines = [f"EVENT_{(sample // SECONDS_A_BLOCK % 4) * 10 + n % 10 if n >= 30 else n:02d}.ALL\t2,000,000,000\t{r.choice(values)}" for n in range(CORE_EVENTS)]
            lines += [f"UNC_CHA_EVENT_{n}\t2,000,000,000\t{r.choice(values)}" for n in range(UNIT_EVENTS)]
            sizes += f.write(second + "\n" + "\n".join(lines) + "\n" + "-" * 10 + "\n")
            sample += 1
            if sample % SECONDS_A_BLOCK == 0:
                sizes += f.write("=" * 10 + "\n")


METRICS = "<root>" + "".join(f'<metric name="metric_ratio_{n}"><event alias="a">EVENT_{n:02d}.ALL</event><event alias="b">EVENT_{n + 1:02d}.ALL</event><formula>a / b</formula></metric>' for n in range(20)) + "</root>"


def measure(spark, megabytes: list[float]) -> dict[str, float]:
    from pulsegrid import cli

    took = {}
    with tempfile.TemporaryDirectory() as folder:
        xml = os.path.join(folder, "metrics.xml")
        with open(xml, "w", encoding="utf-8") as f:
            f.write(METRICS)
        for mb in megabytes:
            trace = os.path.join(folder, f"{mb:g}.dat")
            write_trace(trace, mb)
            for name, flags in (("summary", ["-n"]), ("details", [])):
                began = time.time()
                cli.run(spark, cli.arguments(["parse", trace, "--xml", xml, *flags, "--out", os.path.join(folder, "out")]))
                took[f"parse_{mb:g}MB_{name}"] = round(time.time() - began, 3)
            os.remove(trace)
    return took


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", "8")
    session = SparkSession.builder.master(f"local[{cpus}]").config(map={"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    print(measure(session, [float(x) for x in sys.argv[1:]] or [3.8, 74.0]))
