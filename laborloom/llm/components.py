"""Connected components by alternating star contractions, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborloom.llm.common import discard, saved


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (the smallest node it reaches) for every node with an edge, but those smallest ones.

    Large stars hang a node's larger neighbours on its smallest one, small stars its smaller neighbours; both keep
    connectivity and end in one star per component, where no smaller end of an edge is a larger one elsewhere, after a
    number of rounds logarithmic in the graph. Each round is written to the shared folder. Neighbours are never gathered: stars are made by a minimum and a join.
    """
    high, low = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    graph = saved(edges.filter(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct(), "graph")
    for _ in range(most_rounds):
        inner = graph.join(graph.select(F.col("u").alias("v")), "v", "left_semi")
        if inner.isEmpty() and graph.agg(F.count("u") == F.count_distinct("u")).first()[0]:
            return graph.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, graph = graph, saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "graph")
        discard(before)
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
