import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulsegrid import cli
from pulsegrid.plans import views as V
from pulsegrid.plans.compute import compute_metrics, metric
from pulsegrid.sources import metrics_xml, sysinfo
from pulsegrid.sources.trace import read_trace, uncore_devices

RULE = "-" * 41
HEAD = f"""NUMA node(s):                    2
TSC Freq ............. 2000.00 MHz
{RULE}
OS Processor\tPhys. Package\tCore\tLogical Processor
{RULE}
0\t0\t0\t0
1\t0\t0\t1
{RULE}

Processor Features:
\t(Hyper-Threading) (Enabled)
\t(Cores Per Package:   1)
System Features:
\t(Number of Packages:    1)
Uncore Performance Monitoring Units:
\tcha             : 2
Version Info: mini
"""
BODY = """01/02/2024 03:04:05.000
INST\t2,000,000,000\t100\t200
----------
01/02/2024 03:04:06.000
CLK\t2,000,000,000\t50\t150
----------
==========
01/02/2024 03:04:07.000
INST\t4,000,000,000\t400\t400
----------
01/02/2024 03:04:08.000
CLK\t2,000,000,000\t60\t140
----------
==========
"""
XML = """<root><metric name="metric_CPI"><throughput-metric-name>t</throughput-metric-name><event alias="a">CLK</event><event alias="b">INST</event><formula>a / b</formula><formula socket="0">0</formula></metric>
<metric name="metric_EDP EMON Sampling time (seconds)"><constant alias="a">$samplingTime</constant><formula>a</formula></metric>
<metric name="late"><event alias="a">INST:retire_latency</event><formula>a</formula></metric><metric name="cha"><constant alias="a">system.cha_count/system.socket_count</constant><formula>a</formula></metric></root>"""


@pytest.fixture()
def trace(tmp_path):
    def write(body=BODY, head=HEAD):
        p = tmp_path / "t.dat"
        p.write_bytes((head + body).encode())
        return str(p)

    return write


def system(spark, path):
    events, info = read_trace(spark, path)
    return events, info, V.make_view("system", constants=info.symbols(), metrics=tuple(metrics_xml.parse(XML)))


def close(a, b):
    return a == b or a is not None and b is not None and abs(a - b) < 1e-8 * max(1, abs(b))


@pytest.mark.parametrize("change", [lambda b: b, lambda b: b.replace("\n", "\r\n"), lambda b: b.removesuffix("==========\n")])
def test_details_of_the_small_trace(spark, trace, change):
    events, info, view = system(spark, trace(change(BODY), change(HEAD)))
    rows = V.details(events, view, info.ref_tsc).orderBy("group", "timestamp").select("group", "INST", "CLK", "metric_CPI").collect()
    want = [(1, 300.0, None, None), (1, None, 200.0, 2 / 3), (2, 400.0, None, None), (2, None, 200.0, 0.5)]
    assert all(close(x, y) for r, w in zip(rows, want, strict=True) for x, y in zip(r, w, strict=True))


def test_summary_and_statistics_of_the_small_trace(spark, trace):
    events, info, view = system(spark, trace())
    rows = {r["stat"]: r for r in V.system_summary(events, view, info.ref_tsc).collect()}
    want = {"aggregated": (1100 / 3, 200.0, 200 / (1100 / 3)), "min": (300.0, 200.0, 0.5), "max": (400.0, 200.0, 2 / 3), "95th percentile": (395.0, 200.0, 0.6583333333333333), "variation (stdev/avg)": (1 / 7, 0.0, 1 / 7)}
    for stat, w in want.items():
        assert all(close(rows[stat][c], x) for c, x in zip(("INST", "CLK", "metric_CPI"), w)), stat
    top = rows["aggregated"]
    assert close(top["$samplingTime"], 5.0) and close(top["$processed_samples"], 4.0) and close(top["metric_EDP EMON Sampling time (seconds)"], 1.25)
    assert "late" not in top and top["cha"] == 2.0


@pytest.mark.parametrize("size", [64, 200, 1 << 20])
def test_file_splits_change_nothing(spark, trace, size):
    path = trace(BODY * 20)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = read_trace(spark, path)[0].where("name = 'CLK'").groupBy("group").agg(F.sum("value")).orderBy("group").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in got] == [(g, 200.0) for g in range(1, 41)]


def test_missing_and_bad_values(spark, trace):
    body = "junk\tbefore\n01/02/2024 03:04:05.789\nINST\t10\tN/A\nCLK\t10\t1\t2\t3\nBARE\n----------\n==========\n"
    events, _ = read_trace(spark, trace(body))
    rows = {(r["name"], r["unit"]): r for r in events.collect()}
    assert all(str(rows["INST", u]["value"]) == "nan" for u in (0, 1)) and rows["CLK", 1]["value"] == 2.0 and ("BARE", 0) not in rows
    assert rows["CLK", 0]["timestamp"] == datetime(2024, 1, 2, 3, 4, 5, 789000) and rows["TSC", 1]["value"] == 10.0 and rows["CLK", 0]["device"] == "core"


def test_uncore_units_ranges_and_topdown(spark, trace):
    head = HEAD.replace("1\t0\t0\t1\n", "1\t1\t0\t0\n")
    body = "".join(f"01/02/2024 03:04:0{i}.000\nUNC_CHA_X\t10\t1\t2\t3\t4\nPERF_METRICS.RETIRING\t10\t1\t1\nPERF_METRICS.BAD_SPECULATION\t10\t3\t0\nPERF_METRICS.HEAVY\t10\t2\t2\nTOPDOWN.SLOTS:perf_metrics\t10\t8\t8\n----------\n" for i in range(3)) + "==========\n"
    events, info = read_trace(spark, trace(body, head), samples_between=(2, 2))
    assert uncore_devices(events) == ["UNC_CHA"] and {r[0] for r in events.select(F.second("timestamp")).collect()} == {1}
    got = {(r["socket"], r["unit"]): r["value"] for r in events.where("name = 'UNC_CHA_X'").collect()}
    assert got == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 3.0, (1, 1): 4.0}
    got = {(r["name"][13:], r["unit"]): r["value"] for r in events.where("name like 'PERF%'").collect()}
    assert got["RETIRING", 0] == 2.0 and got["RETIRING", 1] == 8.0 and got["HEAVY", 0] == 4.0
    view = V.make_view("uncore", "UNC_CHA", constants=info.symbols())
    assert sorted(r["Device"] for r in V.summary(events, view, info.ref_tsc).collect()) == ["0_0", "0_1", "1_0", "1_1"] and view.constants["CHAS_PER_SOCKET"] == 1.0
    between = read_trace(spark, trace(body, head), times_between=("2024-01-02 03:04:01", "2024-01-02 03:04:02"))[0]
    assert between.select("timestamp").distinct().count() == 2
    with pytest.raises(Exception, match="dealt"):
        read_trace(spark, trace(body.replace("\t3\t4\n", "\t3\n"), head))[0].collect()


def test_header(trace):
    info = sysinfo.parse(HEAD.split("\n"))
    assert info.ref_tsc == 2e9 and info.attributes["NUMA node(s)"] == 2 and info.features["processor"] == {"Hyper-Threading": True, "Cores Per Package": 1}
    s = info.symbols()
    assert s["chas_per_socket"] == 2 and s["THREADS_PER_CORE"] == 2 and s["CORES_PER_SOCKET"] == 1 and s["SOCKET_COUNT"] == 1 and s["THREADS_PER_SOCKET"] == 2
    with pytest.raises(sysinfo.HeaderError):
        sysinfo.parse(["TSC Freq ..... 1 MHz"])


def test_views_core_thread_socket(spark, trace):
    events, info, _ = system(spark, trace())
    for level, devices in (("core", ["0_0"]), ("thread", ["0", "1"]), ("socket", ["0"])):
        assert sorted(r["Device"] for r in V.summary(events, V.make_view(level), info.ref_tsc).collect()) == devices
        assert V.details(events, V.make_view(level), info.ref_tsc).count() == 4 * len(devices)
    with pytest.raises(ValueError):
        V.add_views([V.make_view("core"), V.make_view("core")])


def test_metrics_need_their_inputs_and_constants_win(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "`x.y` double, z double")
    out, names = compute_metrics(df, [metric("m", "a+b", a="x.y", b="z"), metric("n", "a", a="absent")], {"z": 10.0})
    assert names == ["m"] and out.first()["m"] == 11.0


def test_command_line(spark, trace, tmp_path):
    xml = tmp_path / "m.xml"
    xml.write_text(XML)
    files = cli.run(spark, cli.arguments(["parse", trace(), "--xml", str(xml), "-sct", "--out", str(tmp_path / "out")]))
    assert len(files) == 5
    text = (tmp_path / "out" / "__edp_system_view_details.csv").read_text().split("\n")
    assert text[0].startswith("group,timestamp,metric_CPI") and len(text) == 6
    book = zipfile.ZipFile(tmp_path / "out" / "summary.xlsx")
    assert b"metric_CPI" in book.read("xl/worksheets/sheet1.xml") and len([n for n in book.namelist() if "worksheets/sheet" in n]) == 4


def test_streaming_sums_equal_batch_sums(spark, trace, tmp_path):
    from pulsegrid.streaming.replay import replay

    events, _ = read_trace(spark, trace())
    events.write.parquet(str(tmp_path / "events"))
    view, seen = V.make_view("system"), []
    q = replay(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), view, lambda df, _: seen.append(sorted(map(tuple, df.collect()))), "0 seconds")
    q.processAllAvailable()
    q.stop()
    assert seen[-1] == sorted(map(tuple, V.aggregate(events, view).collect()))
