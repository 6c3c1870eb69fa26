"""Line dedup with DataFrame functions only: a deletion-neighbourhood join.

A document's lines are its text split at LF; a line is compared without
surrounding spaces and tabs (tabs and CR count as spaces), blank lines are always
kept.  A line goes if an earlier line (by doc_id, then line number; judged on the
input) is equal to it, or one inserted, deleted or replaced character away.

Equal lines are first reduced to their earliest place.  Two lines within one edit
share a key: each line emits itself and every variant with one character deleted,
as hashes.  Both lost a character at the same position (replacement), or one is
the other's variant (insertion, deletion).  In a group of equal keys every line
takes the earliest line that agrees in this way, which is enough to decide it; so
groups make no pairs, only one row for each line and key, verified with
``levenshtein`` at the end.

Few lines have to emit all that.  One edit leaves the first or the last p characters
of a line intact, for any p up to half its length; p is a power of two that both
lines agree on.  Lines of ``LEAST`` characters or more emit the hashes of these
two ends first, and only those that share one go on.  Lines of ``SHORT`` characters or
more are then cut into parts of ``PART`` characters, for m their own length and
one less: an edit lies in one part, and what stands before and after it is equal.
Parts with equal surroundings are compared by their variants, as short lines are.
A group of equal variants holds distinct lines that differ in one given place, so
its size is bounded by the alphabet and the length of a part, not by the data.

The numbers of removed lines are gathered for each document, and the text is
put together anew.  Every join of tables that grow is a sort-merge join, at any size.

Null text has no lines and stays null; an empty table gives no rows.  A row is
known by its doc_id and a hash of its text: rows that share an id but not the text
are documents of their own (in order of that hash), rows that share both get the
same decisions.  A null doc_id sorts first.  Extra columns pass through; columns
named n_lines or n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import fresh, keep, passing, release, survive

LEAST = 16  # shorter lines emit their variants at once
SHORT = 64  # longer lines are compared by parts
PART = 32


def _ends(length: str) -> list[Column]:
    """Hashes of the first and last p characters of a line; p is the power of two from a quarter to a half of a length."""
    p = f"shiftleft(1, length(bin({length})) - 2)"
    return [F.expr(f"xxhash64({p}, {end}, {part}(line, {p}))") for end, part in enumerate(("left", "right"))]


def _parts(long: DataFrame) -> DataFrame:
    """first, a hash of the surroundings and the part, for each part of long lines (first, line)."""
    lengths = long.select("first", "line", F.explode(F.expr(f"filter(array(length(line), length(line) - 1), m -> m >= {SHORT})")).alias("m"))
    cut = lengths.select("first", "line", "m", F.explode(F.expr(f"sequence(0, int((m - 1) div {PART}))")).alias("j"))
    cut = cut.withColumns({"before": F.expr(f"int(j * {PART})"), "after": F.expr(f"int(greatest(m - (j + 1) * {PART}, 0))")})
    around = F.expr("xxhash64(m, j, left(line, before), right(line, after))")
    return cut.select("first", around.alias("c"), F.expr("substr(line, before + 1, length(line) - before - after)").alias("part"))


def _row() -> dict[str, Column]:
    """What a row is known by: doc_id (0 if null), and a hash of its text that also tells whether doc_id is null."""
    return {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_key": F.xxhash64(F.col("doc_id").isNull(), "text")}


def _split(text: str) -> Column:
    return F.split(F.replace(F.replace(text, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" ")), "\n")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands in several."""
    return rows.join(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key).hint("merge"), key, "left_semi")


def _near(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """The first places of lines that are within one edit of an earlier line."""
    spark = docs.sparkSession
    ends = distinct.select("first", "line", F.explode(F.filter(F.array("pre", "suf", "pre2", "suf2"), lambda x: x.isNotNull())).alias("h"))
    likely = keep(_shared(ends, "h").select("first", "line").distinct(), "likely")
    asked = likely.where("line is null").groupBy("first.doc_id", "first.key").agg(F.collect_set("first.no").alias("nos"))
    asked = asked.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("key").alias("_key"), "nos")
    found = docs.withColumns(_row()).join(asked.hint("merge"), ["_id", "_key"]).dropDuplicates(["_id", "_key"])
    at = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("_key").alias("key"), F.col("no")).alias("first")
    found = found.withColumn("_lines", _split("text")).select("doc_id", "_key", "_lines", F.explode("nos").alias("no"))
    long = keep(found.select(at, F.trim(F.get("_lines", F.col("no"))).alias("line")), "long")
    release(spark)
    whole = likely.where("line is not null").unionByName(distinct.where(F.length("line") < LEAST).select("first", "line"))
    parts = whole.where(F.length("line") <= SHORT).select("first", F.lit(0).cast("long").alias("c"), F.col("line").alias("part"))
    parts = parts.unionByName(_shared(_parts(long.unionByName(whole.where(F.length("line") == SHORT))), "c").select("first", "c", "part"))
    variants = parts.select("first", "c", "part", F.explode(F.sequence(F.lit(0), F.length("part"))).alias("i")).select(  # 0: the part itself
        "first", "i", F.xxhash64("c", F.when(F.col("i") == 0, F.col("part")).otherwise(F.concat(F.expr("substr(part, 1, i - 1)"), F.expr("substr(part, i + 1)")))).alias("v"))
    # the earliest place of the same position, and of lines that agree whatever the position
    group, spot = Window.partitionBy("v"), Window.partitionBy("v", "i")
    least = variants.select("first", "i", F.min("first").over(group).alias("any"), F.min(F.when(F.col("i") == 0, F.col("first"))).over(group).alias("whole"), F.min("first").over(spot).alias("same"))
    other = F.when(F.col("i") == 0, F.col("any")).otherwise(F.least("same", "whole"))
    pairs = least.select("first", other.alias("other")).where("other < first").distinct()
    texts = whole.unionByName(long)
    both = pairs.join(texts.hint("merge"), "first").join(texts.select(F.col("first").alias("other"), F.col("line").alias("other_line")).hint("merge"), "other")
    return both.where(F.levenshtein("line", "other_line", 1).between(0, 1)).select("first").distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """_id, _key (see _row) and the sorted numbers (from 0) of its lines that go; documents that lose none are absent."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row()["_key"].alias("key"), F.posexplode(_split("text")).alias("no", "line"))
    rows = rows.select("doc_id", "key", "no", F.trim("line").alias("line")).where("line <> ''")
    size = F.length("line")
    ends = [F.when(size >= LEAST, x).alias(n) for x, n in zip(_ends("length(line)"), ("pre", "suf"), strict=True)]
    ends += [F.when((size > LEAST) & F.expr("length(line) & (length(line) - 1) = 0"), x).alias(n) for x, n in zip(_ends("length(line) - 1"), ("pre2", "suf2"), strict=True)]
    with passing(docs.sparkSession):
        lines = keep(rows.select("doc_id", "key", "no", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), F.when(size <= SHORT, F.col("line")).alias("line"), *ends), "lines")
        at = F.struct("doc_id", "key", "no")
        distinct = keep(lines.groupBy("a", "b").agg(F.min(at).alias("first"), F.max(at).alias("last"), *(F.first(c).alias(c) for c in ("line", "pre", "suf", "pre2", "suf2"))), "distinct")
        near = _near(distinct, docs).withColumn("near", F.lit(True))
        # places: of every line but its earliest place, and of near lines all
        marked = distinct.select("a", "b", "first", "last").join(near.hint("merge"), "first", "left").where("near or last > first").select("a", "b", "first", "near")
        places = lines.select("a", "b", at.alias("at")).join(marked.hint("merge"), ["a", "b"]).where("near or at > first")
        gone = places.groupBy("at.doc_id", "at.key").agg(F.sort_array(F.collect_set("at.no")).alias("gone"))
        return survive(keep(gone.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("key").alias("_key"), "gone"), "gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the text that is left, and n_lines and n_removed; other columns pass through."""
    docs = docs.drop("n_lines", "n_removed")
    keys = fresh(docs, "_id", "_key", "_gone")
    gone = removed_lines(docs.select("doc_id", "text")).toDF(*keys)
    out = docs.withColumns(dict(zip(keys, _row().values()))).join(gone.hint("merge"), keys[:2], "left")
    n = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(keys[2]))
    left = F.when(F.col(keys[2]).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return out.select(*(left.alias(c) if c == "text" else F.col(c) for c in docs.columns), F.when(F.col("text").isNull(), 0).otherwise(n).alias("n_lines"), F.coalesce(F.size(keys[2]), F.lit(0)).alias("n_removed"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (SELECT doc_id, n - 1 AS no, w[n] AS raw, trim(translate(w[n], chr(9) || chr(13), '  ')) AS line
           FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL))),
d AS (SELECT line, min((doc_id, no)) AS first FROM l WHERE line <> '' GROUP BY line),
s AS (SELECT line, first, length(line) AS n FROM d),
v AS (SELECT line, first, n, i, substr(line, 1, i - 1) || substr(line, i + 1) AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM s)),
near AS (SELECT DISTINCT line FROM (
    SELECT a.line FROM v a JOIN v b ON a.v = b.v AND a.i = b.i AND a.first > b.first
    UNION ALL SELECT a.line FROM v a JOIN s b ON a.v = b.line AND a.first > b.first
    UNION ALL SELECT b.line FROM v a JOIN s b ON a.v = b.line AND a.first < b.first)),
m AS (SELECT l.*, l.line <> '' AND ((l.doc_id, l.no) > d.first OR near.line IS NOT NULL) AS gone
      FROM l LEFT JOIN d ON l.line = d.line LEFT JOIN near ON l.line = near.line)
SELECT t.doc_id, coalesce(g.n, 0) AS n_lines, coalesce(g.gone, 0) AS n_removed, CASE WHEN t.text IS NOT NULL THEN sha256(coalesce(g.kept, '')) END AS kept_sha256
FROM documents t LEFT JOIN (SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS gone,
       string_agg(raw, chr(10) ORDER BY no) FILTER (WHERE gone IS NOT TRUE) AS kept FROM m GROUP BY doc_id) g USING (doc_id)
"""
