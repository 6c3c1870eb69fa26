"""Routing of repeated windows: where may a window of a document occur again?

A document is a sequence of units (bytes or words).  Its sample is made of the
minimizers of all half windows: the gram (a short run of units) with the
smallest hash, the leftmost of equal ones.  Equal half windows have the same
minimizer at the same place, so a window can only recur if the minimizers of
all half windows inside it recur.  Windows that pass are routed by the smallest
gram of the whole window; those of one document with the same such gram are one
context, a stretch of text.  All places of a repeated window meet under one key,
in contexts, and unrelated text is left out before any text is sent.

Equal texts are merged into classes first, told apart by 16 bytes; only a class's
smallest document is routed.  Equal contexts under a key are merged before and after
the shuffle.  Where the contexts under one key still make more than a shard (a passage
in very many surroundings), each is cut by a second, longer gram of its windows, and
the cuts, which are shorter and more often equal, are merged and dealt out by both
grams; so up to ``LEVELS`` times, with grams of up to the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import mix, raw
from .store import batch, keep, passing, release, survive

PLACE = np.uint64((1 << 24) - 1)
LEVELS = 3
SALTS = 8


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of each width consecutive keys, the leftmost of equal ones.

    Keys are compared by their upper 40 bits.
    """
    n = len(key)
    if n < width:
        return np.zeros(0, np.int64)
    out = np.empty(n - width + 1, np.int64)
    span = (1 << 24) - width
    for a in range(0, n - width + 1, span):
        part = key[a : a + span + width - 1]
        m = len(part)
        tagged = (part & ~PLACE) | np.arange(m, dtype=np.uint64)
        padded = np.full(-(-m // width) * width, np.uint64(2**64 - 1))
        padded[:m] = tagged
        block = padded.reshape(-1, width)
        left = np.minimum.accumulate(block, axis=1).ravel()
        right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        count = m - width + 1
        least = np.minimum(right[:count], left[width - 1 : width - 1 + count])
        out[a : a + count] = (least & PLACE).astype(np.int64) + a
    return out


class Units:
    """How texts are cut: window and gram sizes, hashes of grams, and the text of a stretch."""

    window: int
    gram: int

    def split(self, buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, Callable[[int, int], bytes]]]:
        """For each row: hashes of its grams at every place, and the text of units [a, b)."""
        raise NotImplementedError

    @property
    def half(self) -> int:
        return self.window // 2


def sampled(units: Units, grams: np.ndarray) -> np.ndarray:
    """The minimizer's place for each half window start."""
    return sliding_least(grams, units.half - units.gram + 1)


def digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text, and (c1, c2): 16 bytes that tell texts apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("c1"), F.xxhash64(F.lit(1), "text").alias("c2"))


def text_classes(docs: DataFrame) -> DataFrame:
    """c1, c2, size and least, the smallest doc_id, of each text; docs of named()."""
    return keep(docs.groupBy("c1", "c2").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")), "classes")


def samples(docs: DataFrame, units: Units) -> DataFrame:
    """c1, c2, anchor and whether the text has it more than once; equal texts of a batch count once."""
    schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("anchor", pa.int64()), ("again", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = raw(b.column(0))
            seen = {k: i for i, k in reversed(list(enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))))}
            new = sorted((i, k) for k, i in seen.items() if offs[i + 1] - offs[i] >= units.window)
            lens = np.diff(offs)[[i for i, _ in new]] if new else np.zeros(0, np.int64)
            sub = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
            part = np.concatenate([buf[offs[i] : offs[i + 1]] for i, _ in new]) if new else buf[:0]
            for (_, (c1, c2)), (grams, _) in zip(new, units.split(part, sub), strict=True):
                if len(grams) < units.window - units.gram + 1:
                    continue
                value, count = np.unique(grams[np.unique(sampled(units, grams))], return_counts=True)
                yield batch(schema, np.full(len(value), c1), np.full(len(value), c2), value.view(np.int64), count > 1)

    return docs.select("text", "c1", "c2").mapInArrow(lambda it: merged(run(it), schema), "c1 long, c2 long, anchor long, again boolean")


def merged(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Small batches joined to larger ones."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()


def route(docs: DataFrame, units: Units, classes: DataFrame) -> DataFrame:
    """Contexts: anchor, cid, c1, c2, least, start, windows, weight, and the text (of the first of equal ones in a batch).

    docs of named(); classes: (c1, c2, least, size).  A text is routed once, by its smallest document.
    """
    found = keep(samples(docs, units), "samples")
    again = found.groupBy("anchor").agg(*(f(c).alias(n) for c in ("c1", "c2") for f, n in ((F.min, f"lo_{c}"), (F.max, f"hi_{c}"))), F.max("again").alias("again"))
    again = again.where("lo_c1 < hi_c1 or lo_c2 < hi_c2 or again").select("anchor")
    mine = found.join(again, "anchor").groupBy("c1", "c2").agg(F.collect_set("anchor").alias("anchors"))
    mine = mine.join(classes.hint("merge"), ["c1", "c2"])
    schema = pa.schema([("anchor", pa.int64()), ("cid", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("least", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("weight", pa.int64()), ("context", pa.binary())])
    whole, half = units.window - units.gram + 1, units.half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = raw(b.column("text"))
            ids = list(zip(*(b.column(c).to_pylist() for c in ("c1", "c2", "least")), strict=True))
            size, known = b.column("size").to_pylist(), b.column("anchors")
            sent: set[tuple[int, int]] = set()
            for i, (grams, text) in enumerate(units.split(buf, offs)):
                if len(grams) < whole:
                    continue
                own = np.sort(known[i].values.to_numpy()).view(np.int64)
                at = sampled(units, grams)
                value = grams[at].view(np.int64)
                ok = own[np.minimum(np.searchsorted(own, value), len(own) - 1)] == value
                good = np.concatenate([[0], np.cumsum(ok)])
                n = len(grams) - whole + 1
                inside = units.window - half + 1
                fit = good[inside : inside + n] - good[:n] == inside
                if not fit.any():
                    continue
                key = sliding_least(grams, whole)
                edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (fit[1:] != fit[:-1])]))
                stop = np.append(edge[1:], n)
                rows = []
                for a, z in zip(edge.tolist(), stop.tolist(), strict=True):
                    if fit[a]:
                        context = text(a, z - 1 + units.window)
                        name = int(grams[key[a]].view(np.int64)), digest(context)
                        rows.append((*name, *ids[i], a, z - a, size[i], None if name in sent else context))
                        sent.add(name)
                yield batch(schema, *zip(*rows, strict=True))

    once = docs.join(mine.hint("merge"), ["c1", "c2"]).where(F.col("doc_id").eqNullSafe(F.col("least")))
    return once.select("text", "c1", "c2", "least", "size", "anchors").mapInArrow(lambda it: merged(run(it), schema, 2000), "anchor long, cid long, c1 long, c2 long, least long, start long, windows long, weight long, context binary")


def decided(routed: DataFrame, units: Units, shard: Callable[[pa.Table], pa.Table], result: str, shard_bytes: int) -> DataFrame:
    """Run shard on bounded groups of distinct contexts (anchor, cid, context, windows, least: smallest, weight: total) and join its result, a binary column of equal pieces for each window, to all places (c1, c2, least, start)."""
    release(routed.sparkSession)
    contexts = keep(merged_contexts(routed), "contexts")
    release(routed.sparkSession)
    found = resolved(contexts, units, shard, result, shard_bytes)
    return routed.select("anchor", "cid", "c1", "c2", "least", "start", "windows").join(found, ["anchor", "cid"])


def merged_contexts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("anchor", "cid").agg(F.first("context", ignorenulls=True).alias("context"), F.first("windows").alias("windows"), F.min("least").alias("least"), F.sum("weight").alias("weight"))


def resolved(contexts: DataFrame, units: Units, shard: Callable[[pa.Table], pa.Table], result: str, shard_bytes: int, level: int = 0) -> DataFrame:
    """(anchor, cid, result) of all contexts.  Anchors with more text than a shard are split by another gram of each window."""
    sizes = contexts.groupBy("anchor").agg(F.sum(F.octet_length("context")).alias("bytes"))
    size, most = sizes.agg(F.sum("bytes"), F.max("bytes")).first()
    shards = max(1, (size or 0) // shard_bytes)
    heavy = sizes.where(F.col("bytes") > shard_bytes).select("anchor", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).hint("merge") if (most or 0) > shard_bytes and level < LEVELS else None
    salted = contexts.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int"))  # the contexts of one anchor go to several tasks
    light = contexts if heavy is None else salted.join(heavy, ["anchor", "salt"], "left_anti").drop("salt")
    found = light.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInArrow(shard, f"anchor long, cid long, {result} binary")
    if heavy is None:
        return found
    kind = "anchor long, cid long, at long, anchor2 long, cid2 long, windows long, least long, weight long, context binary"
    parts = keep(salted.join(heavy, ["anchor", "salt"], "left_semi").drop("salt").mapInArrow(_divided(units, level + 1), kind), "parts")
    release(parts.sparkSession)
    finer = parts.select(F.col("anchor2").alias("anchor"), F.col("cid2").alias("cid"), "windows", "least", "weight", "context")
    deeper = resolved(keep(merged_contexts(finer), "contexts"), units, shard, result, shard_bytes, level + 1).toDF("anchor2", "cid2", result)
    pieces = parts.select("anchor", "cid", "at", "anchor2", "cid2").join(deeper, ["anchor2", "cid2"])
    # a context's windows, put together again in order
    whole = pieces.groupBy("anchor", "cid").agg(F.sort_array(F.collect_list(F.struct("at", result))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda out, x: F.concat(out, x[result]))
    return found.unionByName(whole.select("anchor", "cid", joined.alias(result)))


def _divided(units: Units, level: int):
    """Contexts cut where the smallest of a window's longer grams changes its place; grams of about half, three quarters and all of a window, by level."""
    schema = pa.schema([(c, pa.int64()) for c in ("anchor", "cid", "at", "anchor2", "cid2", "windows", "least", "weight")] + [("context", pa.binary())])
    times = units.window // units.gram * (level + 1) // (LEVELS + 1)  # grams in a longer one
    whole = units.window - times * units.gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = raw(b.column("context"))
            row = list(zip(*(b.column(c).to_pylist() for c in ("anchor", "cid", "windows", "least", "weight")), strict=True))
            for (anchor, cid, n, least, weight), (grams, text) in zip(row, units.split(buf, offs), strict=True):
                count = len(grams) - (times - 1) * units.gram
                long = np.zeros(count, np.uint64)
                for j in range(times):
                    long = mix(long + grams[j * units.gram : j * units.gram + count], 90 + level)
                key = sliding_least(long, whole)[:n]
                edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
                names = mix(long[key[edge]] ^ mix(np.array([anchor], np.int64).view(np.uint64), level), 80).view(np.int64).tolist()
                rows = []
                for a, z, name in zip(edge, [*edge[1:], n], names, strict=True):
                    part = text(a, z - 1 + units.window)
                    rows.append((anchor, cid, a, name, digest(part), z - a, least, weight, part))
                yield batch(schema, *zip(*rows, strict=True))

    return lambda it: merged(run(it), schema, 2000)


def spans_by_text(docs: DataFrame, spans: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """docs of named() with least and size of their text's class and the spans (an array of (a, b), maybe null) that spans(docs, classes) gives by text; its scratch tables are removed."""
    spark = docs.sparkSession
    with passing(spark):
        classes = text_classes(docs)
        per = spans(docs, classes).groupBy("c1", "c2").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
        known = survive(keep(classes.join(per.hint("merge"), ["c1", "c2"], "left"), "spans"))
    release(spark)
    return docs.join(known.hint("merge"), ["c1", "c2"], "left")
