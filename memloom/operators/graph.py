"""The graph of rooms, which are linked where they occur in a common wing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def room_nodes(drawers: DataFrame) -> DataFrame:
    """(room, wings: sorted, n_wings, drawers)"""
    known = drawers.select(F.coalesce("room", F.lit("unknown")).alias("room"), F.coalesce("wing", F.lit("unknown")).alias("wing"))
    out = known.groupBy("room").agg(F.sort_array(F.collect_set("wing")).alias("wings"), F.count("*").alias("drawers"))
    return out.withColumn("n_wings", F.size("wings").cast("long"))


def find_tunnels(nodes: DataFrame, wing_a: str | None = None, wing_b: str | None = None) -> DataFrame:
    """Rooms of at least two wings, with the given ones among them, the fullest first."""
    out = nodes.where("n_wings >= 2")
    for wing in (wing_a, wing_b):
        if wing:
            out = out.where(F.array_contains("wings", wing))
    return out.orderBy(F.desc("drawers"), "room")


def graph_stats(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("total_rooms"), F.count_if(F.col("n_wings") > 1).alias("tunnel_rooms"))


def rooms_per_wing(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("wings").alias("wing")).groupBy("wing").agg(F.count("*").alias("rooms"))


def top_tunnels(nodes: DataFrame, n: int = 10) -> DataFrame:
    return nodes.where("n_wings > 1").orderBy(F.desc("n_wings"), "room").limit(n)


def suggest_rooms(nodes: DataFrame, start: str) -> DataFrame:
    """For a room that isn't there: up to five whose names contain it or are contained, else twenty rooms."""
    near = F.contains("room", F.lit(start)) | F.contains(F.lit(start), F.col("room"))
    ranked = nodes.select("room", near.alias("near")).orderBy(F.desc("near"), "room").limit(20)
    first = Window.orderBy(F.desc("near"), "room")  # over twenty rows
    return ranked.withColumn("nth", F.row_number().over(first)).withColumn("any", F.max("near").over(Window.partitionBy())).where("not any or near and nth <= 5").select("room", "near")


def traverse(drawers: DataFrame, start: str, max_hops: int = 2) -> DataFrame:
    """Breadth-first: (room, hop, via) from a room; via: the wings, comma-joined, shared with the first room that reached it.

    Among rooms of one hop those that an earlier room reached come first, then the smaller
    name: the order of their paths from the start, which needs no ranking. Each hop takes the least path to each
    wing, then to each room of it, so the work follows the members; only whether a frontier is empty
    reaches the driver.
    """
    member = drawers.select("room", "wing").distinct()
    seen = drawers.where(F.col("room") == start).select("room").distinct().select("room", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via"), F.array("room").alias("path"))
    frontier = seen
    for hop in range(1, max_hops + 1):
        wings = frontier.select(F.col("room").alias("from_room"), "path").join(member.withColumnRenamed("room", "from_room"), "from_room")
        per_wing = wings.groupBy("wing").agg(F.min("path").alias("path"))  # before rooms join, so a wing of many rooms makes no pairs of them
        nearest = per_wing.join(member, "wing").join(seen.select("room"), "room", "left_anti").groupBy("room").agg(F.min("path").alias("path"))
        both = nearest.withColumn("from_room", F.element_at("path", -1)).join(member, "room").join(member.withColumnRenamed("room", "from_room"), ["from_room", "wing"])
        nearest = both.groupBy("room", "path").agg(F.sort_array(F.collect_set("wing")).alias("shared"))
        frontier = nearest.select("room", F.lit(hop).alias("hop"), F.array_join("shared", ",").alias("via"), F.concat("path", F.array("room")).alias("path"))
        frontier = frontier.persist()
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen.select("room", "hop", "via")
