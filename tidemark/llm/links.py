"""Connected components of a table of links, as joins and aggregates on that table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import settle


def roots(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): root is the smallest node reachable.

    Each round points every node at its smallest neighbour, follows the pointers to
    their ends, and goes on with the links between different ends. A chain halves per
    step, a star takes one round. Both hot nodes and hot roots only meet sums by key.
    """
    spark = links.sparkSession
    edges = settle(links.select("a", "b").filter(F.col("a") != F.col("b")), "edges")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("low"))
        step = settle(nearest.select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "roots")
        while True:
            # roots are nodes themselves, so each has a row
            ahead = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
            jumped = settle(step.join(ahead, "root").select("node", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")), "roots")
            step = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        if found is None:
            found = step
        else:
            later = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
            found = found.join(later, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
            found = settle(found, "roots")
        of_a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        between = edges.join(of_a, "a").join(of_b, "b").filter(F.col("ra") != F.col("rb"))
        edges = settle(between.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
    if found is None:
        kind = links.schema["a"].dataType.simpleString()
        found = spark.createDataFrame([], f"node {kind}, root {kind}")
    return found
