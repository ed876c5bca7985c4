"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import BROADCAST_ROWS, discard, stored


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """One star step on (u, v) with u > v. Large: each node hands its least
    neighbour to the larger ones; small: to the smaller ones and itself. few: the
    nodes can be broadcast, so that no task gets all edges of a hot one."""
    around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    both = around.join(F.broadcast(least) if few else least, "u")
    if large:
        out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that links (u, v) reach, for each node
    that has a link other than to itself. Large and small stars alternate until
    an edge set repeats; each round is a written table."""
    pairs = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = stored(pairs, "components"), None
    while True:
        row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if row[0] == 0 or row == before:
            break
        before, old = row, edges
        few = 2 * row[0] <= BROADCAST_ROWS
        edges = stored(_star(_star(edges, True, few), False, few), "components")
        discard(old)
    roots = edges.select("v").distinct()
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
    out = stored(out, "component-of")
    discard(edges)
    return out
