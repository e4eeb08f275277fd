"""Connected components of an edge table by least labels, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges(a, b), undirected -> v, comp: every vertex of an edge with the least vertex that it can reach.

    Each round a vertex takes the least label among its own and its neighbours', then the label of that label until none changes, and the edges
    are drawn between the labels; those within one go. So at most half of a round's vertices are left to the next, and all rounds together
    read few more edges than the first. At the end the rounds' labels are joined, the last ones first.
    Messages are map-side combined; labels are cut off by a table in the shared folder.
    A hub's edges are one key of a sort-merge join, which Spark's adaptive execution splits. No vertex's neighbours are ever
    gathered, and tables of past rounds are deleted, so a round takes as much disk as the edges. Self-loops and repeated edges do no harm; null ends are left out; no edges give no rows.
    """
    given = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    left, rounds = materialise(given.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("w")).distinct(), "edges"), []
    while not rounds or left.limit(1).count():
        both = left.unionByName(left.select(F.col("w").alias("v"), F.col("v").alias("w")))
        label = materialise(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("comp")), "labels")
        while True:
            jump = label.select(F.col("v").alias("comp"), F.col("comp").alias("next"))
            step = materialise(label.select("v", "comp").join(jump, "comp").select("v", F.col("comp").alias("old"), F.col("next").alias("comp")), "labels")
            changed = step.where("old <> comp").limit(1).count()
            drop(label)
            label = step
            if not changed:
                break
        rounds.append(label)
        drawn = left.join(label.select("v", F.col("comp").alias("x")), "v").join(label.select(F.col("v").alias("w"), F.col("comp").alias("y")), "w").where("x <> y")
        former, left = left, materialise(drawn.select(F.least("x", "y").alias("v"), F.greatest("x", "y").alias("w")).distinct(), "edges")
        drop(former)
    drop(left)
    out = rounds.pop()
    while rounds:
        inner, outer = rounds.pop(), out
        last = outer.select(F.col("v").alias("comp"), F.col("comp").alias("last"))
        out = materialise(inner.select("v", "comp").join(last, "comp", "left").select("v", F.coalesce("last", "comp").alias("comp")), "labels")
        drop(inner, outer)
    return out.select("v", "comp")
