"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes that are not their own root.

    Alternates large-star and small-star steps until nothing changes. The minimum per node is
    aggregated map-side, written and joined back: a node with very many neighbours is a skewed partition
    of a plain exchange, which adaptive execution splits. Each round is written to the shared folder: no lineage grows.
    """
    state = materialize(edges.select(F.greatest("src", "dst").alias("node"), F.least("src", "dst").alias("root")).where("node != root"), "links")
    before = None
    while True:
        both = state.unionByName(state.select(F.col("root").alias("node"), F.col("node").alias("root")))
        minima = materialize(both.groupBy("node").agg(F.min("root").alias("low")).select("node", F.least("low", "node").alias("low")), "lowest")
        large = both.join(minima, "node").where("root > node").select(F.col("root").alias("node"), F.col("low").alias("root")).distinct()
        lowest = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(lowest, "node").select(F.explode(F.expr("array(struct(node, low AS root), struct(root AS node, low AS root))")).alias("e")).select("e.*").where("node != root").distinct()
        after = materialize(small, "links")
        discard(state)
        discard(minima)
        state = after
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if mark == before:
            return state
        before = mark
