"""Exact Jaccard join of shingle sets by universe partition and pigeonhole.

Sets of n and s shingles with a similarity of at least 0.8 differ in at most
d <= (n + s) / 9 of them.  Equal sets are merged into classes first.

Size bands are [2**b, 2**(b + 1)).  Each band cuts the universe of shingles into
``segments(b)`` parts by hash.  A class indexes the shingles it has in each part
(one signature for each non-empty part) in its own band, and also in the band
below if a partner may lie there.  If more than d non-empty, selective
parts are left, one of them is equal in any partner: equal signatures find it,
and it is enough that this holds for one of the two.  In its own band a class
counts with the largest partner that may look there, of the band above included.

Cost-based allocation: a part that is empty, or whose subset is shared by more
than ``HOT`` classes, tells little and gets no share, as long as the others
suffice.  Where they don't, one-deletion neighbourhoods are indexed (a part with
two shingles or more then bears one difference), and single shingles where even
that is too little; such classes look for one another.

Classes that need their frequent signatures are compared in two steps.  First each
with the smallest class of its group, the hub; links are joined to components.
All groups with one hub make one set of classes, so the many signatures that near
copies share lead to few comparisons.  Where such a set still holds several
components, it is cut into chunks, and pairs of chunks count the shingles their
classes share by a matrix product, exactly.  Two chunks of the hub's own component
are never paired, and of the links found a spanning forest of components is kept.

Every candidate is verified on the whole sets.  Shingles are 64-bit hashes of
five words (A-Z lower-cased); a text with fewer words is one shingle, one without
words has none and links to nothing.

Rows count by their texts, so several rows may share a doc_id: each has the
component of its own text.  Rows with a null doc_id link like others; their
component is the smallest doc_id among its rows, and null if it has none.  Empty
tables give no rows, and other columns than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .kernels import mix, ragged, shingle_sets
from .store import batch, blobs, fresh, keep, passing, release, survive

HOT = 12
CELLS = 128  # counts of shingles by hash cell; their L1 distance never exceeds the sets' difference
BUCKET_ENTRIES = 1_000_000
CHUNK = 1024  # classes, and
CHUNK_SHINGLES = 1 << 19  # shingles of a chunk that is compared with another
FEW = 6  # an entry of more sets is a column of a matrix
COLUMNS = 1024
SALTS = 8
LEAST = 4  # smaller sets have no partner but an equal one


def bound(n, band, lower):
    """Most shingles in which a set of n may differ from a partner that meets it in a band: its own (lower = 0), where larger partners of the band above look too, or the one below (1)."""
    return (n + (np.minimum(5 * n // 4, (2 << np.maximum(band, 0)) - 1) if lower else 5 * n // 4)) // 9


def segments(band: int) -> int:
    u = (2 << band) - 1
    need, m = 1.12 * (u // 4 + 1) + 1, 2
    while m * (1 - math.exp(-u / m)) < need:
        m += max(1, m // 64)
    return m


SEGMENTS = np.array([1, 1, *(segments(b) for b in range(2, 40))], np.int64)


def classes_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """lo, hi, shingles, first index of each row, and two order-free hashes of each row's set."""
    for lo, hi, flat, ptr in shingle_sets(column):
        sums = []
        for salt in (11, 12):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat, salt))])
            sums.append(mix(total[ptr[1:]] - total[ptr[:-1]], salt).view(np.int64))
        yield lo, hi, flat, ptr, *sums


def layout(flat: np.ndarray, ptr: np.ndarray, lower: int) -> tuple:
    """Which part each shingle falls into, in each row's own band (lower = 0) or the one below (1); last, the number of non-empty parts of each row beyond the differences to expect."""
    n = np.diff(ptr)
    band = np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1 - lower
    take = (n >= LEAST) & (band >= 2)
    if lower:
        take &= -(-4 * n // 5) < 2 << np.maximum(band, 0)
    m = np.where(take, SEGMENTS[np.maximum(band, 0)], 0)
    first = np.cumsum(m) - m
    rows = np.flatnonzero(take)
    own = flat[ragged(ptr[:-1][rows], n[rows])]
    row = np.repeat(rows, n[rows])
    part = (mix(own, 21) >> np.uint64(33)).astype(np.int64) % m[row]
    at = first[row] + part
    count = np.bincount(at, minlength=int(m.sum()))
    spare = np.bincount(np.repeat(np.arange(len(n)), m)[count > 0], minlength=len(n)) - bound(n, band, lower)
    return n, band, take, m, first, own, row, at, count, spare


def signatures(flat: np.ndarray, ptr: np.ndarray, lower: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, their rows, and whether they are always needed (of rows with too few parts)."""
    n, band, take, m, first, own, row, at, count, spare = layout(flat, ptr, lower)
    total = len(count)
    value = mix(own, 22)
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, at, value)
    owner = np.repeat(np.arange(len(n)), m)
    inside = np.arange(total) - first[owner]
    salt = mix((band[owner].astype(np.uint64) << np.uint64(32)) + inside.astype(np.uint64), 23)
    full = np.flatnonzero(count)
    sig, who = mix(sums[full] ^ salt[full], 1), owner[full]
    more, more_who = [], []
    for r in np.flatnonzero(take & (spare <= 0)):
        span = slice(first[r], first[r] + m[r])
        mine = np.flatnonzero(count[span]) + first[r]
        tokens = row == r
        more += [mix(sums[mine] ^ salt[mine], 2), mix((sums[at[tokens]] - value[tokens]) ^ salt[at[tokens]], 2)]
        size = len(mine) + int(tokens.sum())
        if np.minimum(count[mine], 2).sum() <= bound(n[r], band[r], lower):
            more.append(mix(own[tokens] ^ mix(np.array([band[r]], np.uint64), 24), 3))
            size += int(tokens.sum())
        more_who.append(np.full(size, r))
    always = np.zeros(len(sig), bool)
    if more:
        sig, who = np.concatenate([sig, *more]), np.concatenate([who, *more_who])
        always = np.concatenate([always, np.ones(len(sig) - len(always), bool)])
    return sig, who, always


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("spare0", pa.int64()), ("spare1", pa.int64()), ("cells", pa.binary())])
    for b in batches:
        for lo, hi, flat, ptr, h1, h2 in classes_of(b.column(2)):
            n = np.diff(ptr)
            cell = np.repeat(np.arange(hi - lo), n) * CELLS + (mix(flat, 31) >> np.uint64(57)).astype(np.int64)
            cells = np.minimum(np.bincount(cell, minlength=(hi - lo) * CELLS), 65535).astype("<u2")
            yield batch(schema, b.column(0)[lo:hi], b.column(1)[lo:hi], n, h1, h2, *(layout(flat, ptr, lower)[-1] for lower in (0, 1)), blobs(np.full(hi - lo, 2 * CELLS), cells.tobytes()))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each set of a batch: all its signatures."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("sigs", pa.binary()), ("tags", pa.binary())])
    for b in batches:
        seen: set[tuple[int, int]] = set()
        for _, _, flat, ptr, h1, h2 in classes_of(b.column(0)):
            n = np.diff(ptr)
            fresh = np.zeros(len(n), bool)
            for i, key in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                if n[i] >= LEAST and key not in seen:
                    seen.add(key)
                    fresh[i] = True
            rows = np.flatnonzero(fresh)
            own = flat[ragged(ptr[:-1][rows], n[rows])]
            sub = np.concatenate([[0], np.cumsum(n[rows])])
            s0, w0, a0 = signatures(own, sub, 0)
            s1, w1, a1 = signatures(own, sub, 1)
            sig, who = np.concatenate([s0, s1]), np.concatenate([w0, w1])
            tag = np.concatenate([a0 * 2, a1 * 2 + 1]).astype(np.uint8)
            by = np.argsort(who, kind="stable")
            size = np.bincount(who, minlength=len(rows))
            yield batch(schema, h1[rows], h2[rows], blobs(size * 8, sig[by].tobytes()), blobs(size, tag[by].tobytes()))


def _spread(buckets: int):
    """Signatures of many classes to one row for each bucket and batch."""
    schema = pa.schema([("bucket", pa.int64()), ("sig", pa.binary()), ("step", pa.binary()), ("tag", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.take(pa.compute.sort_indices(b.column(0)))
            nodes = b.column(0).to_numpy()
            blob = b.column(1).to_pylist()
            size = np.fromiter((len(x) // 8 for x in blob), np.int64, len(blob))
            sig = np.frombuffer(b"".join(blob), np.uint64)
            tag = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8)
            node = np.repeat(nodes, size)
            bucket = ((sig & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            own, count = np.unique(bucket[by], return_counts=True)
            node = node[by]
            step = np.diff(node, prepend=0)
            at = np.cumsum(count) - count
            step[at] = node[at]
            if len(own):
                yield batch(schema, own, blobs(count * 4, (sig[by] >> np.uint64(32)).astype("<u4").tobytes()), blobs(count * 8, step.astype("<i8").tobytes()), blobs(count, tag[by].tobytes()))

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Of one bucket: pairs of classes with an equal signature, and the entries of frequent signatures."""
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u4")
    node = np.concatenate([np.cumsum(np.frombuffer(x, "<i8")) for x in table["step"].to_pylist()])
    tag = np.frombuffer(b"".join(table["tag"].to_pylist()), np.uint8)
    by = np.lexsort((node, sig))
    sig, node, tag = sig[by], node[by], tag[by]
    first = np.ones(len(sig), bool)  # a class counts once for each signature
    first[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node, tag = sig[first], node[first], tag[first]
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(starts, len(sig)))
    a, b = [], []
    for g in range(2, HOT + 1):
        s = starts[size == g]
        for i in range(g):
            for j in range(i + 1, g):
                a.append(node[s + i])
                b.append(node[s + j])
    a, b = (np.concatenate(x) if x else node[:0] for x in (a, b))
    pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
    hot = ragged(starts[size > HOT], size[size > HOT])
    bucket = table["bucket"][0].as_py()
    name = (np.int64(bucket) << 32) + sig[hot].astype(np.int64)
    n, k = pairs.shape[1], len(hot)
    return pa.table({"tag": pa.array(np.concatenate([np.full(n, -1), tag[hot]]), pa.int32()), "a": pa.array(np.concatenate([pairs[0], name]), pa.int64()), "b": pa.array(np.concatenate([pairs[1], node[hot]]), pa.int64())})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, h1, h2, text) to (node, set), where the text has the class's set; of rows in succession with one node the first."""
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])
    last = None
    for b in batches:
        node = b.column(0).to_numpy()
        fresh = np.diff(node, prepend=node[:1] - 1) != 0
        if len(node):
            fresh[0] = node[0] != last
            last = int(node[-1])
        b = b.filter(pa.array(fresh))
        for lo, hi, flat, ptr, h1, h2 in classes_of(b.column(3)):
            part = batch(schema, b.column(0)[lo:hi], blobs(np.diff(ptr) * 8, flat.tobytes()))
            yield part.filter(pa.array((h1 == b.column(1)[lo:hi].to_numpy()) & (h2 == b.column(2)[lo:hi].to_numpy())))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for b in batches:
        keep_ = []
        for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            if 100 * len(x) < 80 * len(y):
                continue
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            if 100 * both >= 80 * (len(x) + len(y) - both):
                keep_.append(i)
        got = b.take(pa.array(keep_, pa.int64()))
        yield batch(schema, got.column(0), got.column(1))


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and cells leave a link possible."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for b in batches:
        n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, CELLS).astype(np.int32) for c in (4, 5))
        ok = (100 * np.minimum(n, m) >= 80 * np.maximum(n, m)) & (9 * np.abs(x - y).sum(1) <= n + m)
        got = b.filter(pa.array(ok))
        yield batch(schema, got.column(0), got.column(1))


def shared_counts(flat: np.ndarray, owner: np.ndarray, rows: int, split: int) -> np.ndarray:
    """Common entries of each of the first ``split`` sets with each of the rest, or of all with all if split is 0.

    flat holds the sets' entries, owner their rows.  Entries of few sets add to
    pairs one by one, frequent ones are columns of a 0/1 matrix that is multiplied.
    """
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    by = np.argsort(inverse, kind="stable")
    who = owner[by]
    starts = np.cumsum(count) - count
    n, m = (split, rows - split) if split else (rows, rows)
    out = np.zeros((n, m), np.float32)
    for g in np.unique(count[count <= FEW]).tolist():
        s = starts[count == g]
        at = who[s[:, None] + np.arange(g)]
        for i in range(g):
            for j in range(g):
                x, y = at[:, i], at[:, j]
                if split:
                    ok = (x < split) & (y >= split)
                    x, y = x[ok], y[ok] - split
                np.add.at(out, (x, y), np.float32(1))
    often = np.flatnonzero(count > FEW)
    for a in range(0, len(often), COLUMNS):
        own = often[a : a + COLUMNS]
        ones = np.zeros((rows, len(own)), np.float32)
        ones[who[ragged(starts[own], count[own])], np.repeat(np.arange(len(own)), count[own])] = 1
        out += ones[:split] @ ones[split:].T if split else ones @ ones.T
    return out


def forest(a: np.ndarray, b: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Indices of edges (a, b) that join components anew, taken in order; top: every node's own number at first."""
    taken = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while top[x] != x:
            top[x] = x = top[top[x]]
        while top[y] != y:
            top[y] = y = top[top[y]]
        if x != y:
            top[max(x, y)] = min(x, y)
            taken.append(k)
    return np.array(taken, np.int64)


def _block(table: pa.Table) -> pa.Table:
    """Of one pair of chunks: links across components, as many as join what they join."""
    table = table.sort_by([("chunk", "ascending"), ("node", "ascending")])
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    node, comp, chunk = (table[c].to_numpy() for c in ("node", "comp", "chunk"))
    comp = np.unique(comp, return_inverse=True)[1]
    sets = table["set"].to_pylist()
    n = np.array([len(x) // 8 for x in sets], np.int64)
    split = 0 if i == j else int((chunk == i).sum())
    empty = pa.array([], pa.int64())
    if i != j and split in (0, len(node)):
        return pa.table({"a": empty, "b": empty})
    both = shared_counts(np.frombuffer(b"".join(sets), np.uint64), np.repeat(np.arange(len(n)), n), len(n), split)
    left, right = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
    both = both.astype(np.int64)
    both *= 9
    link = both >= 4 * n[left, None] + 4 * n[None, right]  # 100 i >= 80 (n + m - i)
    link &= comp[left, None] != comp[None, right]
    x, y = np.nonzero(link)
    y = y + split
    first = np.unique(np.minimum(comp[x], comp[y]) * len(node) + np.maximum(comp[x], comp[y]), return_index=True)[1]
    x, y = x[first], y[first]
    few = forest(comp[x], comp[y], np.arange(len(node)))
    a, b = node[x[few]], node[y[few]]
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    two = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    return two.select("a", "b", "sa", "sb").mapInArrow(_verify, "a long, b long")


def prune(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    own = classes.select("node", "n", "cells")
    a, b = (own.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("cells").alias(f"c{c}")) for c in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(_prune, "a long, b long")


def row_key() -> Column:
    """With doc_id (0 if null), what tells rows of different texts apart."""
    return F.xxhash64(F.col("doc_id").isNull(), "text")


def set_table(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Shingle sets (node, set) of the classes in nodes (node, least, key, h1, h2), read from their first documents; docs: (id, key, text).

    The join leaves rows sorted by id and key, so repeated documents follow one another; a set that
    comes twice all the same (of a partition that was split) does no harm.
    """
    first = nodes.select("node", "h1", "h2", F.coalesce("least", F.lit(0)).alias("id"), "key")
    return first.hint("merge").join(docs, ["id", "key"]).select("node", "h1", "h2", "text").mapInArrow(_sets, "node long, set binary")


def linked_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of all rows (doc_id, n, h1, h2), of classes (node, h1, h2, least: its smallest doc_id, key), and of the classes that have links (node, comp)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    members = keep(docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(_members, "doc_id long, key long, n long, h1 long, h2 long, spare0 long, spare1 long, cells binary"), "members")
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("least"), "key", "n", "spare0", "spare1", "cells")
    some = members.where("n > 0").groupBy("h1", "h2").agg(F.min(first).alias("c"))
    classes = keep(some.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", *(f"c.{x}" for x in ("least", "key", "n", "spare0", "spare1", "cells"))), "classes")
    size = members.agg(F.sum("n")).first()[0] or 0
    release(spark)
    with passing(spark):
        met = keep(_candidates(docs.select("text"), classes.select("h1", "h2", "node"), max(16, size // BUCKET_ENTRIES)), "met")
        release(spark)
        needed = keep(_needed(met.where("tag >= 0").select(F.col("a").alias("sig"), F.col("b").alias("node"), "tag"), classes), "needed")
        hubs = needed.groupBy("sig").agg(F.min("node").alias("hub"))
        stars = survive(keep(beside(needed, hubs, "sig").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars"))
        pairs = survive(keep(prune(met.where("tag = -1").select("a", "b").unionByName(stars).distinct(), classes), "pairs"))
    release(spark)
    with passing(spark):
        asked = pairs.unionByName(stars).select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "least", "key", "h1", "h2"), "node")
        sets = keep(set_table(docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), row_key().alias("key"), "text"), asked), "sets")
        release(spark)
        links = keep(verify(pairs, sets), "links")
        release(spark)
        comps = survive(_joined(stars, classes, sets, components(links)))
    release(spark)
    return members.select("doc_id", "n", "h1", "h2"), classes.select("node", "h1", "h2", "least", "key"), comps


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    members, classes, comps = linked_classes(docs)
    named = comps.join(classes.select("node", "least"), "node")
    named = named.join(named.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("node", "component_id")
    known = classes.join(named, "node", "left").select("h1", "h2", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = members.join(known, ["h1", "h2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """docs without rows that have shingles and an earlier row in their component: by doc_id (null last), then by a hash of the text; of equal rows one stays."""
    _, classes, comps = linked_classes(docs)
    first = F.struct(F.col("least").isNull(), F.coalesce("least", F.lit(0)).alias("_id"), F.col("key").alias("_key"))
    own = classes.join(comps, "node", "left").groupBy(F.coalesce("comp", "node")).agg(F.min(first).alias("f")).select("f._id", "f._key")
    keys = fresh(docs, "_id", "_key")
    rows = docs.withColumns(dict(zip(keys, (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), row_key()))))
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    left = rows.where(words).join(own.toDF(*keys).hint("merge"), keys, "left_semi").dropDuplicates(keys)
    return left.select(*docs.columns).unionByName(rows.where(~words).select(*docs.columns))


def beside(rows: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """rows (node, ...) joined with a table that has one row for each key; rows of a frequent key go to ``SALTS`` tasks."""
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    many = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(many, [key, "_salt"]).drop("_salt")


def _needed(hot: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, node) of frequent signatures and the classes that can't do without them; hot has tag: 1 lower band, 2 always needed."""
    lost = hot.where("tag < 2").groupBy("node", "tag").agg(F.count("*").alias("lost"))
    short = lost.join(classes.select("node", "spare0", "spare1"), "node").where(F.when(F.col("tag") == 0, F.col("spare0")).otherwise(F.col("spare1")) <= F.col("lost")).select("node", "tag")
    return hot.where("tag >= 2").unionByName(hot.join(short, ["node", "tag"])).select("sig", "node").distinct()


def _joined(stars: DataFrame, classes: DataFrame, sets: DataFrame, comps: DataFrame) -> DataFrame:
    """comps after the links across components among the classes of each hub; a table of keep()."""
    comps = keep(comps, "comps")
    spot = stars.select(F.col("a").alias("hub"), F.col("b").alias("node")).unionByName(stars.select(F.col("a").alias("hub"), F.col("a").alias("node"))).distinct()
    spot = spot.join(comps, "node", "left").select("hub", "node", F.coalesce("comp", "node").alias("comp")).join(classes.select("node", "n"), "node")
    home = spot.where("hub = node").select("hub", F.col("comp").alias("home"))
    spot = beside(spot, home, "hub").withColumn("away", F.col("comp") != F.col("home"))
    # chunks of the hub's own component come first, then the others; two chunks of the former need no comparison
    need = lambda away: F.greatest(F.ceil(F.sum(F.when(away, F.col("n"))) / CHUNK_SHINGLES), F.ceil(F.count(F.when(away, 1)) / CHUNK)).cast("long")
    wide = spot.groupBy("hub").agg(need(~F.col("away")).alias("g"), need(F.col("away")).alias("r")).where("r > 0")
    spot = beside(spot, wide, "hub").withColumn("chunk", F.when(F.col("away"), F.col("g") + F.pmod(F.xxhash64("node"), F.col("r"))).otherwise(F.pmod(F.xxhash64("node"), F.col("g"))))
    others = F.sequence(F.when(F.col("away"), F.lit(0).cast("long")).otherwise(F.col("g")), F.col("g") + F.col("r") - 1)
    spot = spot.withColumn("other", F.explode(others)).withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    block = spot.select("hub", "i", "j", "chunk", "node", "comp").join(sets, "node")
    links = keep(block.groupBy("hub", "i", "j").applyInArrow(_block, "a long, b long"), "cross")
    for end in "ab":
        own = comps.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}"))
        links = links.join(own, end, "left").withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
    links = keep(links.distinct(), "links")
    if links.isEmpty():
        return comps
    # of components: the smallest node of several is the smallest component
    merged = components(links).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    every = comps.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comps, "node", "left_anti").withColumn("comp", F.col("node")))
    return keep(every.join(merged, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "comps")


def _candidates(docs: DataFrame, classes: DataFrame, buckets: int) -> DataFrame:
    coded = docs.mapInArrow(_coded, "h1 long, h2 long, sigs binary, tags binary")
    one = coded.groupBy("h1", "h2").agg(F.min(F.struct("sigs", "tags")).alias("c"))
    named = one.join(classes.hint("merge"), ["h1", "h2"]).select("node", "c.sigs", "c.tags")
    spread = named.mapInArrow(_spread(buckets), "bucket long, sig binary, step binary, tag binary")
    return spread.groupBy("bucket").applyInArrow(_meet, "tag int, a long, b long")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[n : n + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS n FROM w)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id FROM w LEFT JOIN c USING (doc_id) JOIN (SELECT id AS doc_id, min(other) AS component_id FROM r GROUP BY id) m USING (doc_id)
"""
