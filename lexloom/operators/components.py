"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed, discard, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", tables: bool = False) -> DataFrame:
    """Rows (node, component) for every node of an edge: the component is its smallest node.

    Alternates two rewritings of the edge table until it no longer changes: every node links its
    larger neighbours, then its smaller ones, to the smallest node that it sees. Each round moves as
    many rows as there are edges and is cut from its lineage by a checkpoint. The number of rounds
    grows with the logarithm of the longest chain. Edges with a null end and loops are left out. With `tables`, rounds are
    stored tables, each of which goes when the next one is there, instead of checkpoints that stay until garbage is collected."""

    def kept(now: DataFrame, last: DataFrame | None = None) -> DataFrame:
        out = stored(now) if tables else checkpointed(now)
        if tables and last is not None:
            discard(last)
        return out

    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    links = kept(links)
    before = None
    while True:
        last = links
        # large star: every neighbour above a node joins the smallest of the node and its neighbours
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        links = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's smaller neighbours, and itself, join the smallest of them
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        links = links.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        links = kept(links, last)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
