"""Connected components of an edge table, in rounds over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketframe.llm.shared import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows ``node, component`` for every node of the edges ``a, b``; the component is its smallest node.

    Each round hangs the neighbours of a node under the smallest of them, first those above the node, then those
    below it. The rounds end when all edges are stars; a chain of n nodes takes about log n rounds. A node with very many
    edges is reduced by a partial minimum before its shuffle, and the joins to these minima have one row per node on
    one side, so adaptive execution can split the other. The first round reads ``edges`` several times; repeated ones do no harm.
    """
    edges = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo")
    while True:
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(edges.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        lowest = both.groupBy("n").agg(F.min(F.least("n", "m")).alias("low"))
        large = both.where("m > n").join(lowest, "n").select(F.col("m").alias("hi"), F.col("low").alias("lo"))
        lowest = large.groupBy("hi").agg(F.min("lo").alias("low"))
        under = large.join(lowest, "hi")
        small = under.select(F.col("lo").alias("hi"), F.col("low").alias("lo")).union(lowest.select("hi", F.col("low").alias("lo")))
        edges = stored(small.where("hi <> lo").distinct(), "edges")
        ends = edges.select(F.col("hi").alias("n"), F.lit(1).alias("above"), F.lit(0).alias("below")).union(edges.select("lo", F.lit(0), F.lit(1)))
        ends = ends.groupBy("n").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
        if not ends.agg(F.expr("max(above + below > 1 AND above > 0)")).first()[0]:
            break
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
