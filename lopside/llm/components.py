"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; ``links`` is (u, v).

    Alternates two steps until nothing changes: every node points its larger
    neighbours, then its smaller ones, at the smallest it knows. Distances
    shrink geometrically; hubs are aggregated before they are joined. The
    component is its smallest node. Null ends are left out.
    """
    pairs = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = materialize(pairs)
    before = None
    while True:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = small.where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        pairs = materialize(pairs)
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    hubs = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(hubs)
