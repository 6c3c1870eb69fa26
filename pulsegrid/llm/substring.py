"""Substring dedup by suffix automata of reference shards.

Repeated 50-word windows are routed to shards of bounded size (see ``anchors``);
the contexts of a shard are its reference.  Each shard's generalized suffix
automaton over words keeps, for each state, the smallest doc_id in which its
strings end.  The contexts then stream through the automaton: the matching
statistics, held at 50 words, lead to the state of each window and so to the
first document that has it.  A window is a repeat if that document is smaller.

The shards together hold every reference text that can match, so each automaton
is sent to the task that streams its documents instead of to all tasks: all of
them together would grow with the corpus.

Windows are judged on the input.  A copy of a smaller document of at least 50
words loses all its words.  Null text has no words.  Words are split at spaces
and the ASCII controls tab to CR, and stay unchanged.  Rows that share a doc_id are
the same document: none is a reference for another, and each loses what smaller
documents have.  Rows without doc_id keep all their words and serve as no reference.
Other columns than doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Units, decided, named, route, spans_by_text
from .kernels import chunks, grams, raw, spans_hash, words
from .store import batch, blobs, keep

WINDOW = 50
SHARD_BYTES = 1 << 17  # an automaton takes over fifty times its text


class Words(Units):
    window, gram = WINDOW, 8

    def split(self, buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, Callable[[int, int], bytes]]]:
        for lo, hi in chunks(offs):
            part = buf[offs[lo] : offs[hi]]
            starts, ends, row = words(part, offs[lo : hi + 1] - offs[lo])
            h = spans_hash(part, starts, ends)
            first = np.searchsorted(row, np.arange(hi - lo + 1))
            for a, b in zip(first[:-1], first[1:], strict=True):
                yield grams(h[a:b], self.gram), lambda x, y, a=a, part=part, starts=starts, ends=ends: b" ".join(part[s:e].tobytes() for s, e in zip(starts[a + x : a + y].tolist(), ends[a + x : a + y].tolist(), strict=True))


class Automaton:
    """A suffix automaton of several word sequences; least is the smallest owner of a state's strings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [2**63 - 1]

    def _state(self, moves: dict[int, int], link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.least.append(2**63 - 1)
        return len(self.length) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link = self.next, self.link
        clone = self._state(dict(nxt[q]), link[q], self.length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def add(self, sequence: list[int], owner: int) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
            else:
                cur = self._state({}, 0, length[last] + 1)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
                last = cur
            if owner < least[last]:
                least[last] = owner

    def close(self) -> None:
        """Hand owners down to the strings' suffixes."""
        link, least = self.link, self.least
        for s in np.argsort(np.array(self.length), kind="stable")[::-1].tolist():
            p = link[s]
            if p >= 0 and least[s] < least[p]:
                least[p] = least[s]

    def stream(self, sequence: list[int], k: int) -> list[int]:
        """The smallest owner of each k words of a sequence; 2**63 - 1 where the automaton doesn't have them."""
        nxt, link, length = self.next, self.link, self.length
        state = have = 0
        out = []
        for i, c in enumerate(sequence):
            while state and c not in nxt[state]:
                state = link[state]
                have = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                have += 1
            if have > k:
                have = k
            while have and length[link[state]] >= have:
                state = link[state]
            if i >= k - 1:
                out.append(self.least[state] if have >= k else 2**63 - 1)
        return out


def _shard(table: pa.Table) -> pa.Table:
    """The first document of every window of every context."""
    texts, owners = table["context"].to_pylist(), table["least"].to_pylist()
    anchors = table["anchor"].to_numpy()
    _, inverse, count = np.unique(anchors, return_inverse=True, return_counts=True)
    names: dict[bytes, int] = {}
    sequences: list[list[int]] = []
    automaton = Automaton()
    for i, text in enumerate(texts):
        sequences.append([names.setdefault(w, len(names)) for w in text.split(b" ")] if count[inverse[i]] > 1 else [])
        automaton.add(sequences[-1], owners[i])
    automaton.close()
    n = table["windows"].to_numpy()
    found = [np.array(automaton.stream(s, WINDOW), np.int64) if s else np.full(k, o, np.int64) for s, k, o in zip(sequences, n.tolist(), owners, strict=True)]
    return pa.table({"anchor": table["anchor"], "cid": table["cid"], "first": blobs(n * 8, np.concatenate(found).tobytes())})


def hit_spans(batches: Iterator[pa.RecordBatch], hits: Callable[[pa.Buffer, int], np.ndarray], window: int) -> Iterator[pa.RecordBatch]:
    """Stretches (c1, c2, a, b) covered by windows; hits tells those of a row from its result and least."""
    schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    for b in batches:
        out = []
        for c1, c2, least, start, found in zip(*(b.column(c).to_pylist() for c in ("c1", "c2", "least", "start")), b.column(4), strict=True):
            hit = np.flatnonzero(hits(found.as_buffer(), least))
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > window)
                out += [(c1, c2, start + x, start + y + window) for x, y in zip(hit[np.append(0, cut + 1)].tolist(), hit[np.append(cut, len(hit) - 1)].tolist(), strict=True)]
        if out:
            yield batch(schema, *zip(*out, strict=True))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the word stretches that go (spans), and whole: a copy of a smaller document."""

    def spans(docs: DataFrame, classes: DataFrame) -> DataFrame:
        routed = keep(route(docs, Words(), classes.where("least is not null")), "routed")
        found = decided(routed, Words(), _shard, "first", SHARD_BYTES).select("c1", "c2", "least", "start", "first")
        return found.mapInArrow(lambda it: hit_spans(it, lambda first, least: np.frombuffer(first, np.int64) < least, WINDOW), "c1 long, c2 long, a long, b long")

    out = spans_by_text(named(docs), spans)
    return out.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.col("spans")).alias("spans"), (F.col("doc_id") > F.col("least")).alias("whole"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words that are left, joined by one space."""
    return _cut(docs, "kept string", lambda kept: kept.decode(), pa.string())


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the words that are left."""
    return _cut(docs, "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest(), pa.string())


def covered(n: int, spans: list | None, whole: bool | None, least: int) -> np.ndarray:
    """Which of n units go."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or []:
        edge[s["a"]] += 1
        edge[s["b"]] -= 1
    gone = np.cumsum(edge[:n]) > 0
    return np.ones(n, bool) if whole and n >= least else gone


def _cut(docs: DataFrame, column: str, result: Callable[[bytes], object], kind: pa.DataType) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), (column.split()[0], kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = raw(b.column("text"))
            n, gone, kept = [], [], []
            for i, (x, y) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                own = buf[x:y].tobytes().split()
                out = covered(len(own), b.column("spans")[i].as_py(), b.column("whole")[i].as_py(), WINDOW)
                n.append(len(own))
                gone.append(int(out.sum()))
                kept.append(result(b" ".join(w for w, o in zip(own, out.tolist(), strict=True) if not o)))
            yield batch(schema, b.column("doc_id"), n, gone, kept)

    return repeated_spans(docs).select("doc_id", "text", "spans", "whole").mapInArrow(run, f"doc_id long, n_words long, n_removed long, {column}")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, n, array_to_string(w[n : n + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS n FROM w)),
f AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY g) AS first FROM s),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(n, n + 50)) AS p FROM f WHERE first < doc_id) GROUP BY doc_id),
k AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(len(gone), 0) AS n_removed, w, gone FROM w LEFT JOIN c USING (doc_id)),
x AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, gone, unnest(range(1, len(w) + 1)) AS p FROM k)
      WHERE NOT list_contains(coalesce(gone, []), p)) GROUP BY doc_id)
SELECT doc_id, n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN x USING (doc_id)
"""
