"""Connected components of a table of links, by joins and minima.

Each round takes the smallest label among a node and its neighbours and then
follows the label one step further (pointer jumping), until nothing changes.
A node with very many links costs one row per partition after the partial
minimum; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.llm.storage import written


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of long ids -> id, component (the smallest id reachable); nodes without links are absent."""
    links = links.where("a is not null and b is not null and a != b").select("a", "b")
    edges = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = (edges.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near")))
        least = (label.join(near, F.col("id") == F.col("a"))
                 .select("id", "component", F.least("component", "near").alias("new")))
        up = label.select(F.col("id").alias("at"), F.col("component").alias("up"))
        step = (least.join(up, F.col("new") == F.col("at"), "left")
                .select("id", F.least("new", F.coalesce("up", "new")).alias("component"), (F.col("component") != F.least("new", F.coalesce("up", "new"))).alias("changed")))
        step = written(step, "labels")
        label = step.select("id", "component")
        if step.where("changed").isEmpty():
            return label


def extended(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``label(id, component)`` after further ``links(a, b)``: these are followed between whole components only."""
    named = links
    for end in ("a", "b"):
        named = (named.join(label.withColumnsRenamed({"id": "_id", "component": "_in"}), F.col(end) == F.col("_id"), "left")
                 .withColumn(end, F.coalesce("_in", end)).drop("_id", "_in"))
    up = components(named.where("a != b").distinct()).withColumnsRenamed({"id": "_id", "component": "_in"})
    ends = links.select("a").unionByName(links.select(F.col("b").alias("a"))).distinct()
    new = ends.join(label, F.col("a") == F.col("id"), "left_anti").select(F.col("a").alias("id"), F.col("a").alias("component"))
    every = label.unionByName(new).join(up, F.col("component") == F.col("_id"), "left")
    return written(every.select("id", F.coalesce("_in", "component").alias("component")), "labels")
