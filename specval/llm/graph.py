"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specval.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(``u``, ``v``) gives (``node``, ``root``) for every node of an edge.

    Each round maps a node to the smallest of itself and its neighbours and contracts the edges, so components shrink at least by
    half; two nodes of a component always end at one root. Tables are written each round; nothing is gathered on the driver.
    """
    edges = materialize(edges.select("u", "v").filter("u <> v").distinct(), "graph-edges")
    both = edges.union(edges.select("v", "u"))
    roots = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root")), "graph-roots")
    step = roots
    turn = 0
    while True:
        a, b = step.select(F.col("node").alias("u"), F.col("root").alias("ru")), step.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        edges = edges.join(a, "u").join(b, "v").select(F.col("ru").alias("u"), F.col("rv").alias("v")).filter("u <> v").distinct()
        edges = materialize(edges, f"graph-edges{turn}")
        if edges.isEmpty():
            return roots
        both = edges.union(edges.select("v", "u"))
        step = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root")), f"graph-step{turn}")
        onward = step.select(F.col("node").alias("root"), F.col("root").alias("__next"))
        roots = materialize(roots.join(onward, "root", "left").select("node", F.coalesce("__next", "root").alias("root")), f"graph-roots{turn}")
        turn += 1
