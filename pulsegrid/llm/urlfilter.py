"""URL filters: a sort-merge range join of urls with (host, path) rules.

A host becomes its labels in reverse, so that a rule's host and all of its
subdomains form one interval of sorted keys.  Each task sorts its urls by key
and sweeps them beside the sorted rules; a stack holds the rules whose interval
the sweep is inside, the innermost on top.  Rules are broadcast in blocks of at
most ``RULE_BLOCK``, so the size of a broadcast is bounded whatever their number.

The longest rule wins: more host characters first, then the longer path; of
equal rules, block.  Null url, or one without ``://``: host and path are empty
and no rule fits.  Urls without a rule get the default verdict, allow.  Hosts are
lower-cased in A-Z alone.  Rows are judged one by one, whatever their page_id; other
columns pass through, those named host, path, rule or verdict are replaced.  An empty
table gives no rows; without rules every url gets the default.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import plus

RULE_BLOCK = 20_000
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path columns."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr({0}, instr({0}, '://') + 3)".format("url"))).otherwise("")
    rest = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1), F.lit(""))


def key(host: str) -> tuple[str, ...]:
    return tuple(reversed(host.split(".")))


def sweep(keys: list[tuple[tuple[str, ...], str]], rules: list[tuple[tuple[str, ...], list]]) -> list[tuple | None]:
    """The winning (host length, path length, blocks, rule, verdict) for each (key, path), both sides sorted by key."""
    stack: list[tuple[tuple[str, ...], list]] = []
    at, out = 0, []
    for k, path in keys:
        while at < len(rules) and rules[at][0] <= k:
            r = rules[at]
            while stack and r[0][: len(stack[-1][0])] != stack[-1][0]:
                stack.pop()
            stack.append(r)
            at += 1
        while stack and k[: len(stack[-1][0])] != stack[-1][0]:
            stack.pop()
        found = None
        for _, paths in reversed(stack):  # innermost host first; paths are sorted, the longest first
            found = next((won for p, won in paths if path.startswith(p)), None)
            if found:
                break
        out.append(found)
    return out


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """pages (with a url column) with host, path, rule and verdict; other columns pass through."""
    url = F.col("url")
    host, path = split_url(url)
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    ordered = sorted({(v, h.translate(str.maketrans(UPPER, LOWER)), p) for v, h, p in rules})
    blocks = [ordered[i : i + RULE_BLOCK] for i in range(0, len(ordered), RULE_BLOCK)] or [[]]
    schema = plus(pages, rule="string", verdict="string", _won="long")
    for n, part in enumerate(blocks):
        by: dict[tuple[str, ...], list] = {}
        for verdict, h, p in part:
            by.setdefault(key(h), []).append((p, (len(h), len(p), verdict == "block", h + p, verdict)))
        table = sorted((k, sorted(v, key=lambda x: (-x[1][1], not x[1][2]))) for k, v in by.items())
        shared = pages.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, n=n) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
                keys = [key(h) for h in hosts]
                order = sorted(range(len(keys)), key=keys.__getitem__)
                won: list = [None] * len(keys)
                for i, x in zip(order, sweep([(keys[i], paths[i]) for i in order], shared.value), strict=True):
                    won[i] = x
                old = list(zip(b.column("rule").to_pylist(), b.column("verdict").to_pylist(), b.column("_won").to_pylist(), strict=True)) if n else [(None, default, -1)] * len(keys)
                new = [(x[3], x[4], rank) if x and (rank := x[0] << 33 | x[1] << 1 | x[2]) > o[2] else o for x, o in zip(won, old, strict=True)]
                first = [c for c, f in zip(b.columns, b.schema.names, strict=True) if f not in ("rule", "verdict", "_won")]
                yield pa.RecordBatch.from_arrays([*first, *(pa.array([x[j] for x in new], t) for j, t in enumerate((pa.string(), pa.string(), pa.int64())))], names=[f.name for f in schema])

        pages = pages.mapInArrow(run, schema)
    return pages.drop("_won")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES).drop("url")


OP7_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
s AS (SELECT page_id, regexp_extract(r, '^([^?#]*)', 1) AS r FROM u),
p AS (SELECT page_id, translate(regexp_extract(r, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/]*(.*)$', 1) AS path FROM s),
rules(verdict, h, q) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, h || q AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(q) DESC) AS n
      FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.n = 1
"""
