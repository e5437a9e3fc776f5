"""Connected components of a link table, by label spreading and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(v, comp) of every vertex of ``links`` (a, b: long); comp is the smallest vertex that
    is reachable. Each round takes the smallest label among neighbours, summed up before the
    shuffle, then the label of that label, and is written to the shared checkpoint folder;
    the rounds grow with the logarithm of the longest path. No links give no rows."""
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("comp")))
    while True:
        near = (both.join(label, both.b == label.v).groupBy("a").agg(F.min("comp").alias("m")))
        low = (label.join(near, label.v == near.a, "left")
               .select("v", F.col("comp").alias("was"), F.least("comp", F.coalesce("m", "comp")).alias("low")))
        jump = label.select(F.col("v").alias("low"), F.col("comp").alias("far"))
        step = cut_lineage(low.join(jump, "low", "left")
                           .select("v", "was", F.least("low", F.coalesce("far", "low")).alias("comp")))
        label = step.select("v", "comp")
        if step.filter("was <> comp").isEmpty():
            return label
