"""Language ID: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, every other character counts as a space, and n-grams
of one to three characters that hold a letter are hashed to ``BUCKETS``.  The
driver holds one log-probability matrix (buckets x languages), which is
broadcast; a batch of texts is scored as a sparse matrix with ones, by one
gather and one segmented sum.

Training reads whole texts of at most ``TRAIN_DOCS`` labelled rows: those whose
id hashes smallest, so the choice does not depend on the number of rows or on
partitioning.  Every text is predicted.

Null text, or text without a letter: ``und``, score 0.  Rows without lang are
not learned from.  No labelled row at all: every text gets ``und``.  Ties go to
the language that sorts first.  The score is the posterior of the best language.
Rows are predicted one by one, whatever their doc_id; a null doc_id is not held out.
Other columns pass through, those with the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import batch, plus

BUCKETS = 1 << 16
TRAIN_DOCS = 4000
ORDERS = (1, 2, 3)
PIECE = 1 << 20
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x323B0) if chr(i).isalpha()]] = True
        _LETTER.append(table)
    return _LETTER[0]


def ngram_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams with a letter, piece by piece; pieces overlap so that none is lost or twice there."""
    longest = max(ORDERS)
    low = text.lower()
    for a in range(0, len(low), PIECE):
        back = min(a, longest - 1)
        c = np.frombuffer(low[a - back : a + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        has = letters()[c]
        c = np.where(has, c, np.uint32(32)).astype(np.uint64)
        for n in ORDERS:
            m = len(c) - n + 1
            if m <= 0:
                continue
            h, some = np.full(m, n, np.uint64), np.zeros(m, bool)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + c[j : m + j]
                some |= has[j : m + j]
            skip = max(0, back - n + 1)
            h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
            yield h[skip:][some[skip:]].astype(np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(len(x) for x in ngram_buckets(text))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
    for b in batches:
        total: dict[str, np.ndarray] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            row = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for x in ngram_buckets(text or ""):
                row += np.bincount(x, minlength=BUCKETS)
        for lang, row in total.items():
            at = np.flatnonzero(row)
            yield batch(schema, [lang] * len(at), at.astype(np.int32), row[at])


class Model:
    """Languages, and log probabilities of every bucket in each (priors are uniform)."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.logp = np.log((counts + 0.5) / (counts.sum(0, keepdims=True) + 0.5 * BUCKETS)) if langs else counts

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        best, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return best, score
        flat: list[np.ndarray] = []
        rows: list[int] = []
        size = 0
        total = np.zeros((len(texts), len(self.langs)))
        seen = np.zeros(len(texts), bool)

        def flush() -> None:
            if flat:
                lens = np.array([len(x) for x in flat])
                part = np.add.reduceat(self.logp[np.concatenate(flat)], np.cumsum(lens) - lens, axis=0)
                np.add.at(total, rows, part)
                flat.clear()
                rows.clear()

        for i, text in enumerate(texts):
            for x in ngram_buckets(text or ""):
                if len(x):
                    flat.append(x)
                    rows.append(i)
                    seen[i] = True
                    size += len(x)
            if size > PIECE:
                flush()
                size = 0
        flush()
        at = total.argmax(1)
        share = np.exp(total - total.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        for i in np.flatnonzero(seen):
            best[i], score[i] = self.langs[at[i]], min(1.0, float(share[i, at[i]]))
        return best, score


def train(labelled: DataFrame, max_docs: int = TRAIN_DOCS) -> Model:
    """Fit on (doc_id, text, lang); rows with null text or lang are left out."""
    some = labelled.where("text is not null and lang is not null").select("lang", "text", F.xxhash64(F.col("doc_id").cast("string")).alias("_h"), "doc_id")
    ids = some.select("_h").orderBy("_h").limit(max_docs).agg(F.max("_h")).first()[0]
    if ids is None:
        return Model([], np.zeros((BUCKETS, 0)))
    found = some.where(F.col("_h") <= ids).select("lang", "text").mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    counts = np.zeros((BUCKETS, len(langs)))
    counts[found["bucket"].to_numpy(), [langs.index(x) for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns; every other column passes through (clashing names are replaced)."""
    docs = docs.drop(pred, score)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp))
    schema = plus(docs, **{pred: "string", score: "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model([], np.zeros((1, 0)))
        m.langs, m.logp = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                b = whole.slice(a, 1024)
                names, score_ = m.scores(b.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(score_, pa.float64())], names=[*b.schema.names, pred, score])

    return docs.mapInArrow(run, schema)


def held_out() -> F.Column:
    """True for the quarter of documents that is never learned from."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.coalesce(held_out(), F.lit(False))
    model = train(docs.where(~out))
    return predict(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
