"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import discard, materialized, renamed


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours under the smallest node around it."""
    both = links.union(links.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hangs itself and its smaller neighbours under the smallest of them."""
    down = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node but the smallest of each component.

    ``links`` has two columns of ids; direction, repeats and loops do not matter. Minima are taken with map-side
    combination, and the joins that hand them back are plain ones whose hot nodes the adaptive planner splits. Each round is written
    to the shared folder; the loop ends when a round changes nothing. No link gives an empty result.
    """
    now = materialized(links.toDF("u", "v").where("u <> v").distinct(), "links")
    state = None
    while True:
        after = materialized(_small_star(_large_star(now)), "links")
        mark = F.xxhash64("u", "v").cast("decimal(38,0)")
        seen = after.agg(F.count("*").alias("n"), F.sum(mark).alias("s")).first()
        discard(now)
        now = after
        if seen == state:
            return renamed(now, "node", "component")
        state = seen
