"""Token ids in files: canonical, length-limited Huffman codes from global counts.

Writing takes three passes.  (1) Texts are dealt out by ranges of (doc_id, a hash
of the text), as many as the session has shuffle partitions; each task sorts its
range, encodes it with the tokenizers library and packs whole documents into
blocks.  The library gets the distinct pre-tokens of a stretch of documents, and
whole texts wherever special tokens or hashes call for it.  (2) The ids that each task
counted are summed up.  (3) Package-merge gives code lengths of at most ``MAX_BITS``, and
every block is coded alone.

A file set is a folder with two Parquet tables: ``code`` (one row: the code
length of every id) and ``blocks`` (part, block, first token number, doc ids,
their token counts, and a payload).  A payload holds, for each run of ``RUN``
ids, the number of bits it takes (uint16: the checkpoints), then the code bits,
most significant first.  Blocks are independent: a reader needs the code table
and one row.  It decodes all runs of a block side by side, one table lookup for
each id.

Parts ascend by doc_id, blocks ascend in a part, documents in a block.  Null
text is the empty text: only the end id is stored.  A null doc_id sorts first.
Rows with one doc_id are in the order of a hash of their text; equal rows are stored
each.  An empty table gives an empty file set with an empty code.  Other columns
than doc_id and text are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .kernels import STEP, mix, powers
from .store import batch, new_path, remove, save

MAX_BITS = 16
RUN = 64
BLOCK_IDS = 1 << 16
JOINED = 64  # pre-tokens in one text for the library
CALL = 64  # such texts in one call


def runs(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """As ragged, by one running sum of 32 bits; all numbers are under 2**31."""
    full = lens > 0
    starts, lens = (starts, lens) if full.all() else (starts[full], lens[full])
    step = np.ones(int(lens.sum()), np.int32)
    if len(starts):
        step[0] = starts[0]
        step[np.cumsum(lens[:-1])] = starts[1:] - starts[:-1] - lens[:-1] + 1
    return np.cumsum(step, out=step)


class LibraryEncoder(bpe.Encoder):
    """The same blocks and gathers, with distinct pre-tokens encoded by the tokenizers library.

    Known pre-tokens are found by a hash table with open addressing (``slots``: places in ``known``, or -1).
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        super().__init__(bpe.vocabulary(path), self.by_library)

    def clear(self) -> None:
        super().clear()
        self.slots, self.used = np.full(1 << 16, -1, np.int32), np.zeros(0, bool)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash in known, or -1."""
        last = len(self.slots) - 1
        slot = (h & np.uint64(last)).astype(np.int32)
        out = self.slots[slot]
        if not len(self.known):
            return out
        left = np.flatnonzero((self.known[out] != h) & (out >= 0))
        while len(left):
            slot[left] = slot[left] + 1 & last
            out[left] = self.slots[slot[left]]
            left = left[(self.known[out[left]] != h[left]) & (out[left] >= 0)]
        return out

    def enter(self, place: np.ndarray) -> None:
        """Slots for these places of known; the table grows so that at least half of it is free."""
        if 2 * len(self.known) > len(self.slots):
            self.slots = np.full(1 << (4 * len(self.known) - 1).bit_length(), -1, np.int32)
            place = np.arange(len(self.known))
        last = len(self.slots) - 1
        slot = (self.known[place] & np.uint64(last)).astype(np.int32)
        while len(place):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = place[free]
            left = self.slots[slot] != place
            place, slot = place[left], slot[left] + 1 & last

    def trim(self) -> None:
        """Keep the pre-tokens that came again since they were entered or last kept, if they are few enough."""
        kept = np.flatnonzero(self.used)
        if 2 * len(kept) > bpe.CACHE_WORDS:
            kept = kept[:0]
        known, start, count, ids = self.known[kept], self.start[kept], self.count[kept], self.ids
        self.clear()
        self.known, self.count, self.ids = known, count, ids[runs(start, count)]
        self.start, self.used = np.cumsum(count) - count, np.zeros(len(kept), bool)
        self.enter(np.arange(len(kept)))

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > bpe.CACHE_WORDS:
            self.trim()
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.cumsum(lens) - lens
        joined = "".join(texts)
        c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if not len(c):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        starts = bpe.pre_tokens(c, edges[lens > 0])
        size = np.diff(np.append(starts, len(c)))
        value = char_hashes()[c]
        value *= powers(int(size.max()))[runs(np.zeros(len(size), np.int64), size)]
        h = mix(np.add.reduceat(value, starts) + size.astype(np.uint64) * STEP, 7)
        at = self.find(h)
        new = np.flatnonzero(at < 0)
        self.used[at[at >= 0]] = True
        if len(new):
            fresh, where, times = np.unique(h[new], return_index=True, return_counts=True)
            w = new[where]
            flat, count = self.words_to_ids([joined[a:b].encode() for a, b in zip(starts[w].tolist(), (starts[w] + size[w]).tolist(), strict=True)])
            place = np.arange(len(self.known), len(self.known) + len(w))
            self.start = np.concatenate([self.start, np.cumsum(count) - count + len(self.ids)])
            self.ids, self.known, self.count = np.concatenate([self.ids, flat]), np.concatenate([self.known, fresh]), np.concatenate([self.count, count])
            self.used = np.concatenate([self.used, times > 1])
            self.enter(place)
            at[new] = self.find(h[new])
        count = self.count[at]
        ids = self.ids[runs(self.start[at], count)]
        total = np.concatenate([[0], np.cumsum(count)])
        first = np.searchsorted(starts, np.append(edges, len(c)))
        return ids, np.diff(total[first])

    def _part(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids have to give a block's bytes back, as in the class above; its documents are compared one by one only if they don't."""
        plain = ["" if self.special and self.special.search(t) else t for t in texts]
        ids, n = self.block(plain)
        if self.vocab.text[runs(self.vocab.offs[ids], self.vocab.lens[ids])].tobytes() != "".join(plain).encode():
            yield from super()._part(texts)
            return
        stop = np.cumsum(n).tolist()
        for t, p, a, b in zip(texts, plain, [0, *stop], stop, strict=False):
            yield ids[a:b] if p == t else self._special(t)

    def by_library(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens that stay apart beside others go in long texts: a space and a character of another kind as they are, words that begin without a space with a line feed after each.  Ids are told apart by their bytes."""
        texts = [w.decode() for w in words]
        kind = bpe.classes()[np.frombuffer("".join([t[0] + (t[1:2] or " ") for t in texts]).encode("utf-32-le"), np.uint32)].reshape(-1, 2) != bpe.SPACE
        spaced = ~kind[:, 0] & kind[:, 1] & np.fromiter((t[0] == " " for t in texts), bool, len(texts))
        out, count = [], np.zeros(len(texts), np.int64)
        order = [np.flatnonzero(spaced), np.flatnonzero(kind[:, 0]), np.flatnonzero(~spaced & ~kind[:, 0])]
        for own, end in zip(order, ("", "\n"), strict=False):
            for a in range(0, len(own), CALL * JOINED):
                part = own[a : a + CALL * JOINED]
                asked = [texts[i] + end for i in part.tolist()]
                flat = self._ids(["".join(asked[b : b + JOINED]) for b in range(0, len(asked), JOINED)])[0]
                stop = np.cumsum(np.fromiter((len(words[i]) + len(end) for i in part.tolist()), np.int64, len(part)))
                bytes_ = np.cumsum(self.vocab.lens[flat])
                last = np.searchsorted(bytes_, stop)
                if last[-1] >= len(bytes_) or (bytes_[last] != stop).any():  # a token across two words: the library cuts them otherwise
                    return self._ids(texts)
                count[part] = np.diff(last + 1, prepend=0) - len(end)
                out.append(np.delete(flat, last) if end else flat)
        alone, count[order[2]] = self._ids([texts[i] for i in order[2]])
        order = np.concatenate(order)
        first = np.zeros(len(texts), np.int64)
        first[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate([*out, alone])[runs(first, count)], count

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.int32), *got]), np.fromiter(map(len, got), np.int64, len(got))


_CHARS: list[np.ndarray] = []


def char_hashes() -> np.ndarray:
    """A hash of every code point."""
    if not _CHARS:
        _CHARS.append(mix(np.arange(0x110000, dtype=np.uint64)))
    return _CHARS[0]


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most limit bits, by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    kinds, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([leaf, packages])
        is_leaf = np.concatenate([np.ones(len(leaf), bool), np.zeros(len(packages), bool)])
        by = np.argsort(both, kind="stable")
        kinds.append(is_leaf[by])
        both = both[by]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(leaf) - 2
    lens = np.zeros(len(leaf), np.int64)
    for k in reversed(kinds):
        leaves = int(k[:take].sum())
        lens[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lens
    return out


class Code:
    """Canonical codes: by length, then id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = np.zeros(len(lengths), np.uint32)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        n = self.lengths[order]
        span = (1 << (MAX_BITS - n)).astype(np.int64)
        low = np.cumsum(span) - span
        self.codes[order] = (low >> (MAX_BITS - n)).astype(np.uint32)
        self.symbol = np.zeros(1 << MAX_BITS, np.int32)
        self.symbol[: int(span.sum())] = np.repeat(order, span)
        self.entry = self.symbol.astype(np.int64) << 5 | self.lengths[self.symbol]

    def pack(self, ids: np.ndarray) -> bytes:
        """Checkpoints and code bits."""
        n = self.lengths[ids]
        end = np.cumsum(n)
        at = end - n
        out = np.zeros(int(end[-1] + 7 >> 3) + 3 if len(ids) else 0, np.uint8)
        if len(ids):
            word = at >> 5
            bits = self.codes[ids].astype(np.uint64) << (64 - n - (at & 31)).astype(np.uint64)
            # bits of different ids never overlap; every word of 32 bits has an id that begins in it, and its last id may reach into the next word
            both = np.add.reduceat(bits, np.flatnonzero(np.diff(word, prepend=-1)))
            words = np.zeros(len(both) + 1, np.uint64)
            words[:-1] = both >> np.uint64(32)
            words[1:] |= both & np.uint64(0xFFFFFFFF)
            flat = words.astype(">u4").view(np.uint8)[: len(out)]
            out[: len(flat)] = flat
        bits = np.add.reduceat(n, np.arange(0, len(ids), RUN)) if len(ids) else n
        return bits.astype("<u2").tobytes() + out.tobytes()

    def unpack(self, payload: bytes, count: int) -> np.ndarray:
        """The ids of a payload of count ids; all runs advance together."""
        runs = -(-count // RUN)
        bits = np.frombuffer(payload, "<u2", runs).astype(np.int64)
        data = np.frombuffer(payload, np.uint8, offset=2 * runs).astype(np.int32)
        three = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        out = np.zeros((RUN, runs), np.int32)
        at = np.cumsum(bits) - bits
        last = count - RUN * (runs - 1)
        for j in range(RUN):
            here = at[: runs if j < last else runs - 1]
            found = self.entry[three[here >> 3] >> (8 - (here & 7)) & 0xFFFF]
            out[j, : len(here)] = found >> 5
            here += found & 31
        return out.T.reshape(-1)[:count]


def squeeze(ids: np.ndarray) -> bytes:
    """Compressed ids of 16 bits, or of 32 if need be, for the passes in between only."""
    return pa.Codec("zstd", 1).compress(ids.astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4").tobytes(), asbytes=True)


def unsqueeze(blob: bytes, count: int) -> np.ndarray:
    for kind in ("<u2", "<u4"):
        try:
            raw = pa.Codec("zstd").decompress(blob, int(kind[2]) * count, asbytes=True)
        except OSError:
            continue
        if len(raw) == int(kind[2]) * count:
            break
    return np.frombuffer(raw, kind).astype(np.int32)


def _encode(path: str, end_id: int):
    """Sorted documents of one part to blocks of whole documents; the last one has the part's ids (seen) and how often they came (times)."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("skip", pa.int64()), ("key", pa.int64()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary()), ("seen", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = LibraryEncoder.of(path), TaskContext.get().partitionId()
        block, skip, docs, held, key = 0, 0, [], [], None
        total, ready = np.zeros(max(e.vocab.size, end_id + 1), np.int64), None

        def flush() -> tuple:
            nonlocal block, skip, total
            n, ids = [len(x) for x in held], np.concatenate(held)
            total += np.bincount(ids, minlength=len(total))
            out = [part], [block], [skip], [key], [list(docs)], [n], [squeeze(ids)]
            block, skip = block + 1, skip + sum(n)
            docs.clear()
            held.clear()
            return out

        size = 0
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                b = whole.slice(a, 1024)
                for d, k, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), e.encode(b.column(2).to_pylist()), strict=True):
                    key = k if not docs else key
                    docs.append(d)
                    held.append(np.append(own, end_id).astype(np.int32))
                    size += len(own) + 1
                    if size >= BLOCK_IDS:
                        if ready:
                            yield batch(schema, *ready, [None], [None])
                        ready, size = flush(), 0
        if docs:
            if ready:
                yield batch(schema, *ready, [None], [None])
            ready = flush()
        if ready:
            at = np.flatnonzero(total)
            yield batch(schema, *ready, [at], [total[at]])

    return run


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = 2, out: str | None = None) -> str:
    """Write the file set of docs (doc_id, text) and return its folder."""
    spark = docs.sparkSession
    path = path or bpe.vocabulary_path()
    out = out or new_path(spark, "tokens")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    ordered = docs.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")
    raw_path = save(ordered.mapInArrow(_encode(path, end_id), "part long, block long, skip long, key long, docs array<long>, counts array<long>, ids binary, seen array<int>, times array<long>"), "ids")
    raw = spark.read.parquet(raw_path)
    counted = raw.where("seen is not null").select(F.explode(F.arrays_zip("seen", "times")).alias("c")).groupBy(F.col("c.seen").alias("id")).agg(F.sum("c.times").alias("n")).toArrow()
    counts = np.zeros(max([0, *counted["id"].to_pylist()]) + 1, np.int64)
    counts[counted["id"].to_numpy()] = counted["n"].to_numpy()
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()), MAX_BITS, RUN, 1)], "lengths binary, max_bits int, run int, version int").coalesce(1).write.mode("overwrite").parquet(f"{out}/code")
    # one row for each part: its first token number
    tokens = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    size = raw.groupBy("part").agg(F.sum(tokens).alias("n"), F.min(F.when(F.col("block") == 0, F.struct(F.get("docs", F.lit(0)).alias("d"), "key"))).alias("first")).orderBy("first").select("part", "n").toArrow()
    begin = dict(zip(size["part"].to_pylist(), np.concatenate([[0], np.cumsum(size["n"].to_numpy())])[:-1].tolist(), strict=True))
    shared = spark.sparkContext.broadcast((lengths, begin))
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("start", pa.int64()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("payload", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, first = Code(shared.value[0]), shared.value[1]
        for b in batches:
            for i in range(b.num_rows):
                part, block, skip, docs_, n, ids = (c[i].as_py() for c in b.columns)
                yield batch(schema, [part], [block], [first[part] + skip], [docs_], [n], [code.pack(unsqueeze(ids, sum(n)))])

    raw.drop("key", "seen", "times").mapInArrow(pack, "part long, block long, start long, docs array<long>, counts array<long>, payload binary").write.mode("overwrite").option("compression", "none").parquet(f"{out}/blocks")
    remove(spark, raw_path)
    return out


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document in a file set."""
    return _read(spark, folder, "ids array<int>", pa.list_(pa.int32()), lambda own: own.tolist())


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian uint32."""
    return _read(spark, folder, "ids_crc32 long", pa.int64(), lambda own: zlib.crc32(own.astype("<u4").tobytes()))


def _read(spark: SparkSession, folder: str, column: str, kind: pa.DataType, result) -> DataFrame:
    head = spark.read.parquet(f"{folder}/code").first()
    shared = spark.sparkContext.broadcast(np.frombuffer(bytes(head["lengths"]), np.uint8))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (column.split()[0], kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(shared.value)
        for b in batches:
            for start, docs, counts, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = np.array(counts, np.int64)
                ids = code.unpack(payload, int(n.sum()))
                end = np.cumsum(n)
                yield batch(schema, docs, start + end - n, n, [result(ids[e - k : e]) for e, k in zip(end.tolist(), n.tolist(), strict=True)])

    return spark.read.parquet(f"{folder}/blocks").select("start", "docs", "counts", "payload").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_digests(spark, folder)
