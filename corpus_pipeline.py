"""A pipeline for training text: every stage reads what the one before has written.

Documents go in the stages ``language_id`` (no letter, or no language found with
a probability of a half), ``line_dedup`` (nothing but blank lines left),
``near_duplicates`` (one document of each group stays, the smallest id) and
``decontaminate`` (a benchmark item inside).  The last stage encodes what is left.

Every row counts by doc_id and text: rows that share an id but not the text are
documents of their own, rows that share both are one document.  A null doc_id
sorts first in ``line_dedup`` and last in ``near_duplicates``.  Null and empty
texts go in the first stage.  Empty tables give no rows.  Other columns of
documents pass through, whatever their names; n_chars is set anew where it exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.bpe import token_digests
from pulsegrid.llm.decontam import without_items
from pulsegrid.llm.jaccard import first_of_groups
from pulsegrid.llm.langid import held_out, predict, train
from pulsegrid.llm.linededup import dedup_lines
from pulsegrid.llm.store import fresh, keep, passing, survive

LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs.where(~F.coalesce(held_out(), F.lit(False))))
    pred, score = fresh(docs, "_pred", "_score")
    found = predict(docs, model, pred=pred, score=score)
    return found.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = dedup_lines(docs).where(F.col("text").rlike(r"[^\s]"))
    return left.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_of_groups(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(docs.select("doc_id", "lang", "source", "text")).drop("text")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("tokens", tokens)]

#: Language ID and tokenization can't be written in SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; tables of the others are removed."""
    with passing(spark):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES:
            docs = keep(stage(spark, docs, sf_dir), name)
        return survive(docs)
