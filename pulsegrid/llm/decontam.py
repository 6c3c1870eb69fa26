"""Benchmark decontamination: MinHash containment search in size partitions.

Items are grouped by size: an item of n distinct shingles belongs to the
partition of the next power of two u >= n (16 at least).  For each partition a
document is cut into windows of 2u shingles, one every u, so a passage of up to
u shingles lies wholly in some window and makes up a good part of it.  ``HASHES``
MinHash values of windows and items are compared one by one; any equal one makes
the pair a candidate.  A candidate counts if the document's shingle set holds at
least ``threshold`` of the item's, compared exactly.

Items of fewer than ``FEW`` shingles are too small a part of the smallest window.
They are looked up exactly: a document with one of their shingles is a candidate.

A larger item has a Jaccard similarity of over 0.19 with its window if four fifths
of it or more stand inside, so a miss has a probability below (1 - 0.19) ** 96,
about 2e-9.  Shingles of one item scattered over several windows have less in each,
and a greater probability of a miss.

Words are lower-cased (A-Z), shingles have five words; a document or item of fewer
words has its whole sequence as one shingle, so a short item is found in documents
that have no other words.  Documents or items that are null or without words are
never paired, nor are items with a null item_id.  A null doc_id is returned as such;
repeated rows are judged one by one.  Repeated items count once for each item_id.
Other columns are not read (``without_items`` passes them through).  Empty tables
give no pairs.  Items are broadcast in blocks of at most ``ITEM_BLOCK`` rows or about
``ITEM_BYTES``, and documents are read once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import raw, chunks, word_hashes, shingles, unique_rows, shingle_sets
from .store import batch

HASHES = 96
SMALLEST = 16
FEW = 8
ITEM_BLOCK = 20_000
ITEM_BYTES = 32 << 20
_RNG = np.random.default_rng(8)
XOR = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
ODD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Items:
    """Item shingle sets, sorted shingles of the smallest items and, by size partition and hash, sorted MinHash values."""

    def __init__(self, ids: list, texts: pa.Array):
        self.ids, self.sets = [], []
        for lo, hi, flat, ptr in shingle_sets(texts):
            for i in range(hi - lo):
                own = flat[ptr[i] : ptr[i + 1]]
                if len(own) and ids[lo + i] is not None:
                    self.ids.append(ids[lo + i])
                    self.sets.append(own)
        sizes = np.array([max(SMALLEST, 1 << int(len(s) - 1).bit_length()) for s in self.sets], np.int64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        few = np.array([len(s) < FEW for s in self.sets], bool)
        own = np.flatnonzero(few)
        flat = np.concatenate([np.zeros(0, np.uint64), *(self.sets[i] for i in own)])
        order = np.argsort(flat, kind="stable")
        self.few = flat[order], np.repeat(own, [len(self.sets[i]) for i in own])[order]
        for u in sorted(set(sizes[~few].tolist())):
            own = np.flatnonzero((sizes == u) & ~few)
            mins = np.array([((self.sets[i][:, None] ^ XOR) * ODD).min(0) for i in own])
            order = np.argsort(mins, axis=0, kind="stable")
            self.tables[u] = np.take_along_axis(mins, order, 0), own[order]


def block_mins(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values of every SMALLEST shingles of each row, and each row's first block."""
    count = -(-np.diff(ptr) // SMALLEST)
    first = np.concatenate([[0], np.cumsum(count)])
    starts = (np.arange(first[-1]) - np.repeat(first[:-1], count)) * SMALLEST + np.repeat(ptr[:-1], count)
    out = np.empty((HASHES, len(starts)), np.uint64)
    work = np.empty_like(h)
    for k in range(HASHES):
        np.bitwise_xor(h, XOR[k], out=work)
        np.multiply(work, ODD[k], out=work)
        out[k] = np.minimum.reduceat(work, starts)
    return out, first


def candidates(h: np.ndarray, ptr: np.ndarray, items: Items) -> set[tuple[int, int]]:
    found: set[tuple[int, int]] = set()
    values, owner = items.few
    if len(h) and len(values):
        left, right = np.searchsorted(values, h, "left"), np.searchsorted(values, h, "right")
        row = np.searchsorted(ptr, np.arange(len(h)), "right") - 1
        for at in np.flatnonzero(right > left):
            found.update((int(row[at]), int(i)) for i in owner[left[at] : right[at]])
    if not len(h) or not items.tables:
        return found
    mins, first = block_mins(h, ptr)
    for u, (values, owner) in items.tables.items():
        step = u // SMALLEST
        count = -(-np.diff(first) // step)
        begin = np.concatenate([[0], np.cumsum(count)])
        row = np.repeat(np.arange(len(count)), count)
        starts = (np.arange(begin[-1]) - np.repeat(begin[:-1], count)) * step + np.repeat(first[:-1], count)
        half = np.minimum.reduceat(mins, starts, axis=1)
        whole = half.copy()
        same = row[1:] == row[:-1]
        whole[:, :-1][:, same] = np.minimum(half[:, :-1][:, same], half[:, 1:][:, same])
        for k in range(HASHES):
            left = np.searchsorted(values[:, k], whole[k], "left")
            right = np.searchsorted(values[:, k], whole[k], "right")
            for w in np.flatnonzero(right > left):
                found.update((int(row[w]), int(i)) for i in owner[left[w] : right[w], k])
    return found


def item_blocks(benchmark: DataFrame) -> Iterator[Broadcast]:
    """Ids and texts of the items, in broadcasts of about ``ITEM_BLOCK`` rows and ``ITEM_BYTES`` at most."""
    spark = benchmark.sparkSession
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    rows, size = benchmark.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-rows // ITEM_BLOCK), -(-(size or 0) // ITEM_BYTES))
    for n in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).toArrow()
        yield spark.sparkContext.broadcast((part["item_id"].to_pylist(), part["text"].combine_chunks()))


def held(texts: pa.Array, items: Items, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, item_id, n_item, n_shared) of all items that rows hold; the greatest of an item_id's texts."""
    buf, offs = raw(texts)
    for lo, hi in chunks(offs):
        h, first = word_hashes(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], True)
        h, ptr = shingles(h, first)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for row, i in sorted(candidates(h, ptr, items)):
            own = items.sets[i]
            both = int(np.isin(own, h[ptr[row] : ptr[row + 1]]).sum())
            if both >= threshold * len(own) and (len(own), both) > best.get((row, items.ids[i]), (0, 0)):
                best[row, items.ids[i]] = len(own), both
        yield from ((lo + row, item, *found) for (row, item), found in best.items())


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) of every document that holds an item."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64())])
    out = None
    for shared in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value)
            for b in batches:
                found = list(held(b.column(1), items, threshold))
                yield batch(schema, b.column(0).take(pa.array([x[0] for x in found], pa.int64())), *([x[k] for x in found] for k in (1, 2, 3)))

        got = docs.mapInArrow(run, "doc_id long, item_id long, n_item long, n_shared long")
        out = got if out is None else out.unionByName(got)
    return out


def without_items(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that hold no item; one pass for each block of items, and no shuffle."""
    for shared in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value)
            for b in batches:
                fit = np.ones(b.num_rows, bool)
                fit[[row for row, *_ in held(b.column("text"), items, threshold)]] = False
                yield b.filter(pa.array(fit))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP8_SQL = r"""
WITH t AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT side, id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t WHERE text IS NOT NULL),
s AS (SELECT DISTINCT side, id, array_to_string(w[n : n + 4], ' ') AS g FROM (SELECT side, id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS n FROM w)),
i AS (SELECT id AS item_id, g, count(*) OVER (PARTITION BY id) AS n_item FROM s WHERE side = 'i')
SELECT d.id AS doc_id, item_id, max(n_item) AS n_item, count(*) AS n_shared FROM s d JOIN i USING (g) WHERE d.side = 'd'
GROUP BY d.id, item_id HAVING count(*) >= 0.8 * max(n_item)
"""
