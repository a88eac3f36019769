"""Connected components of a table of links, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, keep: Scratch | None = None, name: str = "components") -> DataFrame:
    """node, comp (smallest node that links reach) for every node of ``links`` (columns a, b).

    Each round every node takes the smallest label among its own and its neighbours' and then its
    label's label; long chains so shrink by half or more a round.  Rounds end when no label moves.
    Each round is a written table, and the one before it is deleted; the last stays in ``keep`` as ``name``.
    """
    spark = links.sparkSession
    keep, own = keep or Scratch(spark), Scratch(spark)
    both = own.table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "both")
    new = own.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).select(F.col("a").alias("node"), "comp", F.lit(True).alias("moved")), "0")
    turn = 0
    while new.filter("moved").limit(1).count():
        turn += 1
        labels = new.select("node", "comp")
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "c").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        label = F.least("next", "far")
        new = own.table(step.join(jump, "next", "left").select("node", label.alias("comp"), (label < F.col("comp")).alias("moved")), str(turn))
        own.drop(str(turn - 1))
    out = keep.table(new.select("node", "comp"), name)
    own.drop()
    return out
