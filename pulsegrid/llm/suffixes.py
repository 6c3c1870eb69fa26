"""Suffix-array dedup of bytes: the difference-cover algorithm (DC3) in shards.

Repeated 400-byte strings are routed to shards of bounded size (see
``anchors``), so that all places of one string meet in a shard.  A shard joins
its contexts and sorts their suffixes by the difference cover modulo 3: sampled
triples are sorted and named, the names are sorted by recursion until they
differ, and the other suffixes are merged in.  Suffixes with a common 400-byte
prefix are then neighbours; these bytes of neighbours are compared, and a group
of more than one place (counting equal texts and contexts) is a repeat.

Strings are judged on the input and never cross documents.  A text that occurs
more than once goes as a whole if it has 400 bytes.  Null text is empty.  Texts
may end up as bytes that are not UTF-8.  Every row is a document, whether its doc_id
is null, repeated or neither.  Other columns than doc_id and text are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Units, decided, named, route, spans_by_text
from .kernels import BYTE, chunks, mix, powers, ragged, raw
from .store import batch, blobs, keep
from .substring import covered, hit_spans

WINDOW = 400
SHARD_BYTES = 1 << 20
COMPARED = 4 << 20


def rolling(buf: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings, by doubling."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have, h, out, done = 1, BYTE[buf], None, 0
    while True:
        if k & have:
            out = h if out is None else out[: len(buf) - done - have + 1] * powers(have + 1)[have] + h[done : len(buf) - have + 1]
            done += have
        if done == k:
            return mix(out[:n], k)
        h = h[:-have] * powers(have + 1)[have] + h[have:] if len(h) > have else h[:0]
        have *= 2


class Bytes(Units):
    window, gram = WINDOW, 32

    def split(self, buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, Callable[[int, int], bytes]]]:
        for lo, hi in chunks(offs):
            part = buf[offs[lo] : offs[hi]]
            h = rolling(part, self.gram)
            for a, b in zip((offs[lo:hi] - offs[lo]).tolist(), (offs[lo + 1 : hi + 1] - offs[lo]).tolist(), strict=True):
                yield h[a : max(a, b - self.gram + 1)], lambda x, y, a=a, part=part: part[a + x : a + y].tobytes()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Sorted suffixes of a sequence of positive numbers, by DC3."""
    n = len(s)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    base = int(t.max()) + 1
    # triples at places 1 and 2 modulo 3; place n closes the first half if needed
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    at = np.concatenate([one, two])
    if base < 1 << 21:
        triple = (t[at] * base + t[at + 1]) * base + t[at + 2]
        order = np.argsort(triple, kind="stable")
        fresh = np.diff(triple[order]) != 0
    else:
        order = np.lexsort((t[at + 2], t[at + 1], t[at]))
        a = at[order]
        fresh = (t[a[1:]] != t[a[:-1]]) | (t[a[1:] + 1] != t[a[:-1] + 1]) | (t[a[1:] + 2] != t[a[:-1] + 2])
    name = np.empty(len(at), np.int64)
    name[order] = np.concatenate([[1], 1 + np.cumsum(fresh)])
    if not fresh.all():
        order = suffix_array(name)
    sample = at[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = np.arange(1, len(sample) + 1)
    sample = sample[sample < n]
    wide = len(at) + 2
    zero = np.arange(0, n, 3)
    key0 = t[zero] * wide + rank[zero + 1]
    by = np.argsort(key0, kind="stable")
    zero, key0 = zero[by], key0[by]
    first, second = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(t[first] * wide + rank[first + 1], key0)
    # (symbol, symbol, rank) pairs of symbols get dense names, so that keys fit 64 bits
    both = np.concatenate([t[second] * base + t[second + 1], t[zero] * base + t[zero + 1]]) if base < 1 << 31 else None
    if both is None:
        raise ValueError("the alphabet is too large")
    _, dense = np.unique(both, return_inverse=True)
    key2 = dense[: len(second)] * wide + rank[second + 2]
    before = before + np.searchsorted(key2, dense[len(second) :] * wide + rank[zero + 2])
    out = np.empty(n, np.int64)
    spot = np.arange(len(zero)) + before
    rest = np.ones(n, bool)
    rest[spot] = False
    out[spot] = zero
    out[rest] = sample
    return out


def same_prefix(data: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Whether each of the sorted suffixes but the last shares its first k bytes with the next (all have k).

    Eight bytes at both ends and in the middle are compared first.  Of what is left, pairs that lie
    at one distance and follow one another in the text overlap in all bytes but one, so each run of
    them is compared once.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    eight = sum(padded[j : j + len(data)] << np.uint64(8 * j) for j in range(8))
    left = np.arange(max(len(order) - 1, 0))
    for at in (0, k - 8, (k - 8) // 2):
        left = left[eight[order[left] + at] == eight[order[left + 1] + at]]
    same = np.zeros(max(len(order) - 1, 0), bool)
    first, shift = order[left], order[left + 1] - order[left]
    by = np.lexsort((first, shift))
    left, first, shift = left[by], first[by], shift[by]
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(first) != 1) | (np.diff(shift) != 0)])) if len(left) else left
    size = np.diff(np.append(edge, len(left)))
    stop = np.cumsum(size + k - 1)
    lo = 0
    while lo < len(edge):  # runs of some million bytes together
        hi = max(lo + 1, int(np.searchsorted(stop, (stop[lo - 1] if lo else 0) + COMPARED, "right")))
        run = slice(lo, hi)
        at = ragged(first[edge[run]], size[run] + k - 1)
        wrong = np.concatenate([[0], np.cumsum(data[at] != data[at + np.repeat(shift[edge[run]], size[run] + k - 1)])])
        begin = np.cumsum(size[run] + k - 1) - (size[run] + k - 1)
        spot = ragged(begin, size[run])
        same[left[ragged(edge[run], size[run])]] = wrong[spot + k] == wrong[spot]
        lo = hi
    return same


def _shard(table: pa.Table) -> pa.Table:
    """For every window of every context, whether it has more than one place."""
    weight, n = table["weight"].to_numpy(), table["windows"].to_numpy()
    anchors = table["anchor"].to_numpy()
    _, inverse, count = np.unique(anchors, return_inverse=True, return_counts=True)
    alone = count[inverse] == 1  # windows of one context hold its key at different places, so they differ
    flags = [np.full(k, w > 1) for k, w in zip(n.tolist(), weight.tolist(), strict=True)]
    many = np.flatnonzero(~alone)
    if len(many):
        contexts = table["context"].to_pylist()
        data = np.frombuffer(b"".join(contexts[i] for i in many), np.uint8)
        size = np.array([len(contexts[i]) for i in many])
        begin = np.cumsum(size) - size
        place = np.zeros(len(data), bool)
        owner = np.repeat(many, size)
        for a, k in zip(begin.tolist(), n[many].tolist(), strict=True):
            place[a : a + k] = True
        order = suffix_array(data.astype(np.int64) + 1)
        order = order[place[order]]
        group = np.cumsum(np.concatenate([[0], ~same_prefix(data, order, WINDOW)]))
        total = np.bincount(group, weights=weight[owner[order]])
        hit = np.zeros(len(data), bool)
        hit[order] = total[group] > 1
        for i, a in zip(many.tolist(), begin.tolist(), strict=True):
            flags[i] = hit[a : a + n[i]]
    return pa.table({"anchor": table["anchor"], "cid": table["cid"], "hits": blobs(n, np.concatenate(flags).astype(np.uint8).tobytes())})


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the byte stretches that go (spans), and whole: its text occurs again."""

    def spans(docs: DataFrame, classes: DataFrame) -> DataFrame:
        routed = keep(route(docs, Bytes(), classes), "routed")
        found = decided(routed, Bytes(), _shard, "hits", SHARD_BYTES).select("c1", "c2", "least", "start", "hits")
        return found.mapInArrow(lambda it: hit_spans(it, lambda hits, _: np.frombuffer(hits, np.uint8), WINDOW), "c1 long, c2 long, a long, b long")

    return spans_by_text(named(docs), spans).select("doc_id", "text", "spans", (F.col("size") > 1).alias("whole"))


def _cut(docs: DataFrame, column: str, result: Callable[[bytes], object], kind: pa.DataType) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), (column.split()[0], kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = raw(b.column("text"))
            n, gone, runs, kept = [], [], [], []
            for i, (x, y) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                out = covered(y - x, b.column("spans")[i].as_py(), b.column("whole")[i].as_py(), WINDOW)
                n.append(y - x)
                gone.append(int(out.sum()))
                runs.append(int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()))
                kept.append(result(buf[x:y][~out].tobytes()))
            yield batch(schema, b.column("doc_id"), n, gone, runs, kept)

    return repeated_bytes(docs).select("doc_id", "text", "spans", "whole").mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {column}")


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary)."""
    return _cut(docs, "kept binary", lambda kept: kept, pa.binary())


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark.read.parquet(f"{sf_dir}/documents.parquet"), "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest(), pa.string())
