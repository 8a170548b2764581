"""Connected components of an edge table by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import HUBS, delete, hot_join, written


def connected_components(edges: DataFrame) -> DataFrame:
    """`a`, `b` of one type to (node, component): the smallest node that links reach. Nodes without an edge are not returned.

    Each round takes the smallest label of neighbours, then the label's own label, and is written to the shared folder; lineage stays
    short, and paths halve. Null ends are dropped; repeated edges and loops do no harm. The edges of a hub that a third of all have are
    not joined in one task, nor are the nodes of a component that holds a third of all.
    """
    spark = edges.sparkSession
    e = edges.select("a", "b").filter("a is not null and b is not null")
    both, path = written(e.union(e.select("b", "a")).distinct(), "edges")
    labels, old = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"), F.count(F.lit(1)).alias("_n")), "labels")
    hubs, path_hubs = written(labels.filter(F.col("_n") > both.count() / HUBS).select("node"), "hubs")
    hub_edges = both.join(F.broadcast(hubs), F.col("b") == F.col("node"), "left_semi")
    plain = both.join(F.broadcast(hubs), F.col("b") == F.col("node"), "left_anti")
    labels = labels.drop("_n")
    while True:
        at_b = labels.withColumnRenamed("node", "b")
        of_hubs = F.broadcast(at_b.join(F.broadcast(hubs), F.col("b") == F.col("node"), "left_semi"))
        near = plain.join(at_b, "b").unionByName(hub_edges.join(of_hubs, "b")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_m"))
        step = labels.join(near, "node").select("node", F.col("component").alias("_was"), F.least("component", "_m").alias("_l"))
        step, path_step = written(step, "step")
        jumped, path_hot = hot_join(step, step.select(F.col("node").alias("_l"), F.col("_l").alias("_ll")), ["_l"])  # a large component has one label
        new, at = written(jumped.select("node", F.col("_ll").alias("component"), (F.col("_ll") != F.col("_was")).alias("moved")), "labels")
        done = new.filter("moved").isEmpty()
        delete(spark, old, path_step, path_hot)
        labels, old = new.drop("moved"), at
        if done:
            delete(spark, path, path_hubs)
            return labels
