"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize


def components(edges: DataFrame, path: bool = False) -> DataFrame:
    """Columns id and label (the smallest id of its component) for every id in ``edges`` (columns a, b); ``path``: also
    the place of each id after each round, that is in ever larger parts of its component.

    Each round every node moves to the neighbour that comes first and the edges are drawn anew between the places taken,
    so the graph shrinks until no edge is left. A hash of id and round gives the order, so that a chain of ascending ids
    shrinks as fast as any. Rounds are written tables in the shared folder; nothing comes to the driver.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    places, number = None, 0
    while True:
        order = lambda c, k=number: F.xxhash64(F.lit(k), c)
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("near")).union(edges.select("b", "a"))
        moved = both.groupBy("id").agg(F.min_by("near", order("near")).alias("near"))
        moved = moved.select("id", F.when(order("near") < order("id"), F.col("near")).otherwise(F.col("id")).alias("to"))
        moved = materialize(moved, "moved")
        if places is None:
            places = moved.select("id", F.col("to").alias("label"), *([F.array("to").alias("path")] if path else []))
        else:
            step = moved.select(F.col("id").alias("label"), "to")
            label = F.coalesce("to", "label")
            longer = [F.concat("path", F.array(label)).alias("path")] if path else []
            places = materialize(places.join(step, "label", "left").select("id", label.alias("label"), *longer), "places")
        to_a = moved.select(F.col("id").alias("a"), F.col("to").alias("x"))
        to_b = moved.select(F.col("id").alias("b"), F.col("to").alias("y"))
        edges = edges.join(to_a, "a").join(to_b, "b").where("x <> y")
        edges = materialize(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            break
        number += 1
    least = places.groupBy("label").agg(F.min("id").alias("least"))
    return materialize(places.join(least, "label").select("id", F.col("least").alias("label"), *(["path"] if path else [])), "components")
