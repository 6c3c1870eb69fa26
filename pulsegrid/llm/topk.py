"""Exact top-k search by inner product: KD-trees per shard.

Space is cut into cells by a coarse KD split of at most ``SAMPLE`` rows (those whose
id hashes smallest); every row falls into a cell, and the rows of a cell are dealt to
shards of about ``SHARD`` rows.  Each shard becomes one KD-tree (median splits by rank
on the widest dimension, tight bounding boxes, leaves of ``LEAF`` rows), stored as one
row.  Queries are packed in blocks of one cell, ``QUERY_BLOCK`` at most.  A task holds
one tree and one block, so memory is bounded, and traverses the tree best-first: a box
bounds the inner product by taking each component from its better side.  Nodes whose
bound is below the query's kth score so far are left out; equal ones are visited, as
ties go to the smaller id.

Blocks meet the shards' boxes first, ``PAGE`` boxes in a row.  Each block searches the
shard with the highest bounds; its kth scores then go to all boxes, and only shards
whose box may still hold a better row get the block and send their tree.

Components are floor(256 * x).  Vectors that are null, empty, or hold null or
non-finite components take no part.  Vectors meet queries of their own dimension
only.  Rows whose id equals the query's are no candidates; a null id takes no
part.  Products beyond 2**53 are computed with whole numbers of any size and
saturate as long.  Repeated rows of one vec_id are candidates each, and a query that
is repeated counts once.  Other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import batch, keep, passing, survive

SHARD = 8192
QUERY_BLOCK = 2048
LEAF = 128
SAMPLE = 16_384
LEAST_SAMPLE = 8  # sampled rows of a cell
PAGE = 2048
EXACT = 2.0**53


def whole_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to (vec_id, dim, vec): floor(256 x) as float64 bytes, rows with missing or odd components left out."""
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary())])
    for b in batches:
        ids, dims, vecs = [], [], []
        for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                continue
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
            if np.isfinite(x).all():
                x = np.floor(256.0 * x)
                if np.isfinite(x).all():
                    ids.append(i)
                    dims.append(len(x))
                    vecs.append(x.tobytes())
        yield batch(schema, ids, dims, vecs)


class Tree:
    """A KD-tree over the rows of x, with ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        self.lo, self.hi, self.kids, self.rows = [], [], [], []
        at = [np.arange(len(ids))]
        spot = 0
        while spot < len(at):
            own = at[spot]
            box = x[own]
            lo, hi = box.min(0), box.max(0)
            self.lo.append(lo)
            self.hi.append(hi)
            wide = int((hi - lo).argmax())
            if len(own) <= LEAF or hi[wide] == lo[wide]:
                self.kids.append(None)
                self.rows.append(own)
            else:
                half = len(own) // 2
                part = np.argpartition(box[:, wide], half)
                self.kids.append((len(at), len(at) + 1))
                self.rows.append(None)
                at += [own[part[:half]], own[part[half:]]]
            spot += 1
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)
        self.ids, self.x = ids, x

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner product, nodes x queries."""
        return self.hi @ np.maximum(q, 0).T + self.lo @ np.minimum(q, 0).T

    def search(self, qid: int, q: np.ndarray, bound: np.ndarray, k: int, kth) -> list[tuple]:
        """Up to k best (score, id), each at least kth (or any, if kth is None)."""
        best: list[tuple] = []  # (-score, id), sorted
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if kth is not None and -b < kth:
                break
            if self.kids[node]:
                for child in self.kids[node]:
                    if kth is None or bound[child] >= kth:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            rows = self.rows[node]
            s = self.x[rows] @ q
            ok = self.ids[rows] != qid
            if kth is not None:
                ok &= s >= kth
            if not ok.any():
                continue
            rows, s = rows[ok], s[ok]
            pick = np.lexsort((self.ids[rows], -s))[:k]
            best = sorted([*best, *((-int(s[i]), int(self.ids[rows[i]])) for i in pick)])[:k]
            if len(best) == k and (kth is None or -best[-1][0] > kth):
                kth = -best[-1][0]
        return [(-s, i) for s, i in best]


def _exact(x: np.ndarray, q: np.ndarray) -> bool:
    return not len(x) or not len(q) or float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < EXACT


def _numbers(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, object)
    out.flat = [int(v) for v in x.flat]
    return out


class Cells:
    """A coarse KD split of space, from a sample: median splits on the widest dimension, one cell for each leaf."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.axis, self.cut, self.kids = [], [], []
        at, self.count = [x], 0
        open_ = 1  # leaves, if nothing were split further
        spot = 0
        while spot < len(at):
            own = at[spot]
            wide = int((own.max(0) - own.min(0)).argmax()) if len(own) else 0
            cut = float(np.median(own[:, wide])) if len(own) > 1 else 0.0
            low = own[:, wide] < cut if len(own) else np.zeros(0, bool)
            if open_ < leaves and len(own) >= 2 * LEAST_SAMPLE and low.any() and not low.all():
                self.kids.append((len(at), len(at) + 1))
                at += [own[low], own[~low]]
                open_ += 1
            else:
                self.kids.append(None)
                cut, wide = self.count, -1
                self.count += 1
            self.axis.append(wide)
            self.cut.append(cut)
            spot += 1

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            n, rows = todo.pop()
            if self.kids[n] is None:
                out[rows] = self.cut[n]
            elif len(rows):
                low = x[rows, self.axis[n]] < self.cut[n]
                todo += [(self.kids[n][0], rows[low]), (self.kids[n][1], rows[~low])]
        return out


def _split(points: DataFrame, shard: int) -> dict[int, Cells]:
    """A split for each of the commonest dimensions of the sample; rows of other dimensions make one cell."""
    rows = points.count()
    sample = points.select("dim", "vec").orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toArrow()
    dims = sample["dim"].to_numpy()
    out = {}
    for dim in np.unique(dims).tolist():
        own = np.frombuffer(b"".join(sample["vec"].filter(pa.array(dims == dim)).to_pylist()), np.float64).reshape(-1, dim)
        out[dim] = Cells(own, -(-rows * len(own) // (len(dims) * shard)))
    return out


def _in_cells(df: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(cells)
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary()), ("cell", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, vecs = b.column(1).to_numpy(), b.column(2).to_pylist()
            cell = np.zeros(b.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                if dim in shared.value:
                    at = np.flatnonzero(dims == dim)
                    cell[at] = shared.value[dim].of(np.frombuffer(b"".join(vecs[i] for i in at), np.float64).reshape(-1, dim))
            yield batch(schema, *b.columns, cell)

    return df.mapInArrow(run, "vec_id long, dim int, vec binary, cell long")


def _dealt(df: DataFrame, size: int, name: str) -> DataFrame:
    """df with a number (name) that groups about size rows of one cell at most, by a hash of the id."""
    wide = df.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).cast("long").alias("n"))
    part = F.pmod(F.xxhash64("vec_id", F.lit(name)), F.col("n"))
    return df.join(wide, ["dim", "cell"]).withColumn(name, F.xxhash64("dim", "cell", part)).drop("n")


def _upper(lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Bounds of the inner product, boxes x queries; up by more than rounding takes, so that no true one is cut."""
    return hi @ np.maximum(q, 0).T + lo @ np.minimum(q, 0).T + np.maximum(np.abs(lo), np.abs(hi)) @ np.abs(q).T * 1e-12


def topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query; both have (vec_id, embedding).  Scratch tables are removed, but for the answer."""
    with passing(vectors.sparkSession):
        return survive(keep(_ranked(vectors, queries, k), "topk"))


def _ranked(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    kind = "vec_id long, dim int, vec binary"
    points = keep(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(whole_numbers, kind), "points")
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(whole_numbers, kind)
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("dim", "vec")).alias("v")).select("vec_id", "v.dim", "v.vec")
    cells = _split(points, SHARD)

    def grow(table: pa.Table) -> pa.Table:
        ids, dim = table["vec_id"].to_numpy(), table["dim"][0].as_py()
        tree = Tree(ids, np.frombuffer(b"".join(table["vec"].to_pylist()), np.float64).reshape(-1, dim))
        return pa.table({"shard": table["shard"][:1], "dim": table["dim"][:1], "box": pa.array([tree.lo[0].tobytes() + tree.hi[0].tobytes()], pa.binary()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({"block": table["block"][:1], "dim": table["dim"][:1], "ids": pa.array([table["vec_id"].to_numpy().tobytes()], pa.binary()), "vecs": pa.array([b"".join(table["vec"].to_pylist())], pa.binary())})

    def page(table: pa.Table) -> pa.Table:
        return pa.table({"page": table["page"][:1], "dim": table["dim"][:1], "shards": pa.array([table["shard"].to_numpy().tobytes()], pa.binary()), "boxes": pa.array([b"".join(table["box"].to_pylist())], pa.binary())})

    trees = keep(_dealt(_in_cells(points, cells), SHARD, "shard").select("shard", "dim", "vec_id", "vec").groupBy("shard", "dim").applyInArrow(grow, "shard long, dim int, box binary, tree binary"), "trees")
    packed = keep(_dealt(_in_cells(asked, cells), QUERY_BLOCK, "block").select("block", "dim", "vec_id", "vec").groupBy("block", "dim").applyInArrow(pack, "block long, dim int, ids binary, vecs binary"), "queries")
    # boxes by the page; a page and a block of queries meet in one row, and only what their bounds leave over sends a tree
    pages = max(1, -(-trees.count() // PAGE))
    boxes = keep(trees.withColumn("page", F.pmod(F.xxhash64("shard"), F.lit(pages)).cast("int")).groupBy("page", "dim").applyInArrow(page, "page int, dim int, shards binary, boxes binary"), "boxes")

    def bounded(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dim = b.column("dim")[i].as_py()
        box = np.frombuffer(b.column("boxes")[i].as_py(), np.float64).reshape(-1, 2, dim)
        q = np.frombuffer(b.column("vecs")[i].as_py(), np.float64).reshape(-1, dim)
        return np.frombuffer(b.column("shards")[i].as_py(), np.int64), np.frombuffer(b.column("ids")[i].as_py(), np.int64), _upper(box[:, 0], box[:, 1], q)

    pair = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("shard", pa.int64()), ("bound", pa.float64())])

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shards, _, bound = bounded(b, i)
                best = int(bound.sum(1).argmax())
                yield batch(pair, b.column("block")[i : i + 1], b.column("dim")[i : i + 1], shards[best : best + 1], [float(bound[best].sum())])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shards, ids, bound = bounded(b, i)
                known = {r["query_id"]: r["score"] for r in b.column("known")[i].as_py() or []}
                least = np.array([float(known.get(int(x), -np.inf)) for x in ids])
                at = np.flatnonzero((bound >= least).any(1))
                yield batch(pair, [b.column("block")[i].as_py()] * len(at), [b.column("dim")[i].as_py()] * len(at), shards[at], bound[at].max(1))

    schema = pa.schema([("query_id", pa.int64()), ("block", pa.int64()), ("dim", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block, dim, tree, ids, vecs, known = (b.column(n)[i].as_py() for n in ("block", "dim", "tree", "ids", "vecs", "known"))
                tree, ids = pickle.loads(tree), np.frombuffer(ids, np.int64)
                q = np.frombuffer(vecs, np.float64).reshape(-1, dim)
                if not _exact(tree.x, q):
                    q, tree.x, tree.lo, tree.hi = map(_numbers, (q, tree.x, tree.lo, tree.hi))
                bound = tree.bounds(q)
                known = {r["query_id"]: r["score"] for r in known or []}
                rows = [(int(qid), s, v) for j, qid in enumerate(ids) for s, v in tree.search(qid, q[j], bound[:, j], k, known.get(int(qid)))]
                clip = 2**63 - 1
                yield batch(schema, [r[0] for r in rows], [block] * len(rows), [dim] * len(rows), [r[2] for r in rows], [max(-clip - 1, min(clip, r[1])) for r in rows])

    out_kind, pair_kind = "query_id long, block long, dim int, vec_id long, score long", "block long, dim int, shard long, bound double"
    nothing = F.lit(None).cast("array<struct<query_id:long,score:long>>")

    def meet(blocks: DataFrame) -> DataFrame:
        return blocks.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1)))).join(boxes, ["page", "dim"]).select("block", "dim", "ids", "vecs", "shards", "boxes", "known")

    seeds = keep(meet(packed.withColumn("known", nothing)).mapInArrow(promising, pair_kind).groupBy("block", "dim").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard")), "promising")
    first = keep(trees.join(seeds, ["shard", "dim"]).join(packed, ["block", "dim"]).withColumn("known", nothing).select("block", "dim", "tree", "ids", "vecs", "known").mapInArrow(find, out_kind), "seeds")
    # k rows have to be there for the kth score to bound anything; a query's rows are k at most here
    kth = first.groupBy("block", "dim", "query_id").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") >= k)
    kth = kth.groupBy("block", "dim").agg(F.collect_list(F.struct("query_id", "score")).alias("known"))
    sent = keep(packed.join(kth, ["block", "dim"], "left"), "sent")
    pairs = keep(meet(sent).mapInArrow(possible, pair_kind).join(seeds, ["block", "dim", "shard"], "left_anti").select("block", "dim", "shard"), "pairs")
    rest = pairs.join(trees, ["shard", "dim"]).join(sent, ["block", "dim"]).select("block", "dim", "tree", "ids", "vecs", "known").mapInArrow(find, out_kind)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk(vectors, vectors.where("vec_id % 50 = 0"), 5)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
