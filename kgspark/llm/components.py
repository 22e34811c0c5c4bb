"""Connected components of links, by label propagation with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import joined, stored


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for every node of ``links`` (a, b); links may repeat or be loops.

    A node with very many links and a component with very many nodes are hot keys, which ``joined`` spreads.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"), F.count("*").alias("n")).select("node", F.least("node", "least").alias("comp"), "n"), "labels")
    while True:
        seen = joined(both, label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("seen"))
        step = stored(label.join(seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "seen").alias("comp"), F.col("n").alias("degree")), "step")
        sizes = step.groupBy("comp").agg(F.count("*").alias("n"))
        far = stored(sizes.join(label.select(F.col("node").alias("comp"), F.col("comp").alias("far")), "comp"), "far")
        moved = stored(joined(step, far, "comp").select("node", "old", F.least("comp", "far").alias("comp"), F.col("degree").alias("n")), "labels")
        if moved.where("comp <> old").isEmpty():
            return moved.select("node", "comp")
        label = moved.select("node", "comp", "n")
