"""Byte-level BPE encoding and decoding in numpy.

Texts are cut into pre-tokens by character classes, the distinct pre-tokens of
a block are encoded together, and ids are gathered back.  The symbols of all
these words lie in one flat array.  Each round finds the lowest rank of every
word by binary search of its adjacent pairs in the sorted pair keys, merges
all its places from left to right, and looks up only the pairs that changed.

Pre-tokens are told apart by a 64-bit hash; decoding then has to give the text
back, and a document for which it doesn't is encoded anew without hashes.

Null text encodes as the empty text: no ids.  The text of a special token
becomes its id, as in the tokenizers library by default.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .kernels import BASE, STEP, mix, powers, ragged
from .store import plus

NONE = np.int32(2**31 - 1)
BLOCK_CHARS = 1 << 20
CACHE_WORDS = 1_000_000
_CLASS: list[np.ndarray] = []
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def classes() -> np.ndarray:
    """Space, letter, number or other, for every code point."""
    if not _CLASS:
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
            find = regex.compile(name + "+")
            for lo in (0, 0x10000, 0x20000, 0x30000):
                plane = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "" for i in range(lo, lo + 0x10000))
                for m in find.finditer(plane):
                    table[lo + m.start() : lo + m.end()] = kind
        _CLASS.append(table)
    return _CLASS[0]


def pre_tokens(c: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of joined texts (code points; each text starts at an edge).

    They follow 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    n = len(c)
    if not n:
        return np.zeros(0, np.int64)
    k = classes()[c]
    first = np.zeros(n + 1, bool)
    first[edges] = True
    first[n] = True
    change = first[:n].copy()
    change[1:] |= k[1:] != k[:-1]
    start = change.copy()
    space = k == SPACE
    # the last space of a run that text follows: joins what follows if it is 0x20, else stands alone
    last = space.copy()
    last[:-1] &= ~space[1:] & ~first[1:n]
    last[-1] = False
    at = np.flatnonzero(last)
    start[at] = True
    joins = at[c[at] == 32]
    start[joins + 1] = False
    # contractions begin at an apostrophe that begins a pre-token
    for a in np.flatnonzero((c == 39) & start):
        if a + 1 >= n or first[a + 1] or k[a + 1] != LETTER:
            continue
        one = chr(c[a + 1])
        two = chr(c[a + 2]) if a + 2 < n and not first[a + 2] else ""
        m = 2 if one in "stmd" else 3 if one + two in ("re", "ve", "ll") else 0
        if m:
            start[a + 1 : a + m] = False
            if a + m < n and k[a + m] == LETTER and not first[a + m]:
                start[a + m] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Tables of a byte-level BPE file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, chars = spec["model"]["vocab"], byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        text = [b""] * self.size
        for t, i in vocab.items():
            text[i] = bytes(chars[x] for x in t)
        for t, i in self.special.items():
            text[i] = t.encode()
        self.lens = np.array([len(x) for x in text], np.int64)
        self.offs = np.cumsum(self.lens) - self.lens
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.of_byte = np.zeros(256, np.int32)
        for x, b in chars.items():
            self.of_byte[b] = vocab[x]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where there is no merge."""
        k = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.rank[at], NONE)

    def merge(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as consecutive bytes, and the number of ids of each (no word is empty)."""
        words = len(lens)
        out_len = np.zeros(words, np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        sym = self.of_byte[data]
        rank = np.full(len(sym), NONE, np.int32)
        if len(sym) > 1:
            rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[np.cumsum(lens) - 1] = NONE
        ids, size = np.arange(words), lens.astype(np.int64)
        while len(ids):
            begin = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, begin)
            live = low != NONE
            if not live.all():
                keep = np.repeat(live, size)
                out_len[ids[~live]] = size[~live]
                done.append((ids[~live], sym[~keep]))
                ids, size, low, sym, rank = ids[live], size[live], low[live], sym[keep], rank[keep]
                if not len(ids):
                    break
            owner = np.repeat(np.arange(len(ids)), size)
            at = np.flatnonzero(rank == low[owner])
            if len(at) > 1:  # of touching places (aaa) every second one merges
                run = np.concatenate([[True], at[1:] != at[:-1] + 1])
                inside = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[inside % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]  # NONE at a word's end stays
            size = size - np.bincount(owner[at + 1], minlength=len(ids))
            place = np.cumsum(keep)[at] - 1
            sym, rank = sym[keep], rank[keep]
            end = np.zeros(len(sym), bool)
            end[np.cumsum(size) - 1] = True
            stale = np.zeros(len(sym), bool)
            stale[place] = True
            stale[place[place > 0] - 1] = True
            look = np.flatnonzero(stale & ~end)
            rank[look] = self.ranks(sym[look], sym[look + 1])
            rank[place[end[place]]] = NONE
        order = np.concatenate([i for i, _ in done]) if done else np.zeros(0, np.int64)
        flat = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int32)
        lens_done = out_len[order]
        first = np.zeros(words, np.int64)
        first[order] = np.cumsum(lens_done) - lens_done
        return flat[ragged(first, out_len)], out_len

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.text[ragged(self.offs[ids], self.lens[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


_ENCODERS: dict[tuple[type, str], Encoder] = {}


class Encoder:
    """Encodes texts; words_to_ids encodes a list of distinct pre-tokens to (flat ids, number of ids of each)."""

    def __init__(self, vocab: Vocabulary, words_to_ids: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]] | None = None):
        self.vocab = vocab
        self.words_to_ids = words_to_ids or self.by_merging
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True)))) if vocab.special else None
        self.clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this process, whose known words serve all its tasks."""
        if (cls, path) not in _ENCODERS:
            _ENCODERS[cls, path] = cls(path) if cls is not Encoder else cls(vocabulary(path))
        return _ENCODERS[cls, path]

    def by_merging(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.vocab.merge(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))

    def clear(self) -> None:
        self.known, self.start, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts without special tokens, and each text's number of ids."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.cumsum(lens) - lens
        c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if not len(c):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        starts = pre_tokens(c, edges[lens > 0])
        size = np.diff(np.append(starts, len(c)))
        inside = np.arange(len(c), dtype=np.int64) - np.repeat(starts, size)
        h = mix(np.add.reduceat(mix(c.astype(np.uint64)) * powers(int(size.max()))[inside], starts) + size.astype(np.uint64) * STEP, 7)
        uniq, where, inv = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, uniq), max(len(self.known) - 1, 0))
        new = self.known[at] != uniq if len(self.known) else np.ones(len(uniq), bool)
        if new.any():
            if len(self.known) + new.sum() > CACHE_WORDS:
                self.clear()
                new[:] = True
            joined = "".join(texts)
            w = where[new]
            flat, count = self.words_to_ids([joined[a:b].encode() for a, b in zip(starts[w].tolist(), (starts[w] + size[w]).tolist(), strict=True)])
            first = np.cumsum(count) - count + len(self.ids)
            self.ids = np.concatenate([self.ids, flat])
            known = np.concatenate([self.known, uniq[new]])
            order = np.argsort(known, kind="stable")  # merges two sorted runs
            self.known, self.start, self.count = known[order], np.concatenate([self.start, first])[order], np.concatenate([self.count, count])[order]
            at = np.searchsorted(self.known, uniq)
        at = at[inv]
        count = self.count[at]
        ids = self.ids[ragged(self.start[at], count)]
        total = np.concatenate([[0], np.cumsum(count)])
        first = np.searchsorted(starts, np.append(edges, len(c)))
        return ids, np.diff(total[first])

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        part: list[str] = []
        room = 0
        for i, text in enumerate(texts):
            part.append(text or "")
            room += len(part[-1])
            if room > BLOCK_CHARS or i == len(texts) - 1:
                yield from self._part(part)
                part, room = [], 0

    def _part(self, texts: list[str]) -> Iterator[np.ndarray]:
        odd = {i for i, t in enumerate(texts) if self.special and self.special.search(t)}
        ids, n = self.block(["" if i in odd else t for i, t in enumerate(texts)])
        offs = np.concatenate([[0], np.cumsum(n)])
        whole = self.vocab.text[ragged(self.vocab.offs[ids], self.vocab.lens[ids])].tobytes() if len(ids) else b""
        size = np.concatenate([[0], np.cumsum(self.vocab.lens[ids])])
        for i, t in enumerate(texts):
            own = ids[offs[i] : offs[i + 1]]
            if i in odd:
                own = self._special(t)
            elif whole[size[offs[i]] : size[offs[i + 1]]] != t.encode():  # two pre-tokens with one hash
                own = self._plain(t)
            yield own

    def _special(self, text: str) -> np.ndarray:
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.vocab.special[m[0]]], np.int32)]
            at = m.end()
        return np.concatenate([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        starts = [*pre_tokens(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.zeros(1, np.int64)).tolist(), len(text)]
        return self.words_to_ids([text[a:b].encode() for a, b in zip(starts[:-1], starts[1:], strict=True)])[0]


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with ids (array<int>) and decoded (string); other columns pass through."""
    return _codec(docs, path or vocabulary_path(), text, lambda v, own: (own.tolist(), v.decode(own)), [("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())])


def token_digests(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with n_tokens, and SHA-256 of the ids (little-endian uint32) and of the decoded text.

    The digests are taken in the task that encodes and decodes, so that ids needn't leave it.
    """

    def digest(v: Vocabulary, own: np.ndarray) -> tuple:
        return len(own), hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(v.decode(own).encode()).hexdigest()

    return _codec(docs, path or vocabulary_path(), text, digest, [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())])


def _codec(docs: DataFrame, path: str, text: str, result: Callable, columns: list[tuple]) -> DataFrame:
    docs = docs.drop(*(n for n, _, _ in columns))
    schema = plus(docs, **{n: kind for n, kind, _ in columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder.of(path)
        v = e.vocab
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                b = whole.slice(a, 1024)
                got = [result(v, own) for own in e.encode(b.column(text).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([g[j] for g in got], t) for j, (_, _, t) in enumerate(columns))], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_digests(docs).drop("text")
