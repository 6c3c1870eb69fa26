"""Connected components of a distributed edge table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep, passing, survive


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of (a, b): comp is the smallest node it reaches.

    Each round takes the least label among a node and its neighbours and then
    follows labels one step, so long chains shrink fast; labels are written to
    the shared folder after every round, and nothing but a flag reaches the driver.
    """
    with passing(edges.sparkSession):
        both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
        labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("comp")), "labels")
        while True:
            seen = labels.select(F.col("node").alias("b"), "comp")
            least = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
            step = labels.join(least, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
            jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
            new = keep(step.join(jump, "comp", "left").select("node", "old", F.least("comp", "far").alias("comp")), "labels")
            if new.where("comp <> old").isEmpty():
                return survive(new).select("node", "comp")
            labels = new.select("node", "comp")
