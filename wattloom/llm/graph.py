"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """node and class (the smallest node of its component) for the links (a, b).

    Each round, every node is merged into its least neighbour, by id and by a fresh hash in turn, and the links are
    renamed; few links are left after a few rounds. Tables are written between rounds; least neighbours and renamings
    are aggregates and joins that Spark can split where one node has very many links.
    """
    links = stored(links.select("a", "b").where("a <> b").distinct(), "graph")
    names = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("name", F.col("node"))
    turn = 0
    while not links.isEmpty():
        order = F.col("y") if turn % 2 == 0 else F.xxhash64("y", F.lit(turn))
        ends = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        near = ends.select(F.col("e.a").alias("x"), F.explode(F.array("e.a", "e.b")).alias("y"))
        into = stored(near.groupBy("x").agg(F.min_by("y", order).alias("into")), "into")
        of_a = into.select(F.col("x").alias("a"), F.col("into").alias("new_a"))
        of_b = into.select(F.col("x").alias("b"), F.col("into").alias("new_b"))
        renamed = links.join(of_a, "a").join(of_b, "b").where("new_a <> new_b")
        links = stored(
            renamed.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct(), "graph"
        )
        names = names.join(into, F.col("name") == F.col("x"), "left")
        names = stored(names.select("node", F.coalesce("into", "name").alias("name")), "names")
        turn += 1
    least = names.groupBy("name").agg(F.min("node").alias("class"))
    return stored(names.join(least, "name").select("node", "class"), "classes")


def extended(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """The classes after more links: only links between different classes are looked at."""
    if classes is None:
        return components(links)
    of_a = classes.select(F.col("node").alias("a"), F.col("class").alias("class_a"))
    of_b = classes.select(F.col("node").alias("b"), F.col("class").alias("class_b"))
    ends = links.join(of_a, "a", "left").join(of_b, "b", "left")
    ends = ends.select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b"))
    top = components(ends)
    moved = top.select(F.col("node").alias("old"), F.col("class").alias("new"))
    kept = classes.join(moved, F.col("class") == F.col("old"), "left").select("node", F.coalesce("new", "class").alias("class"))
    return stored(kept.union(top.join(classes.select("node"), "node", "left_anti")), "classes")
