"""Connected components by large-star and small-star rounds on an edge table (Kiveris et al., SoCC 2014)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"),
                    F.min("u").alias("a"), F.max("v").alias("b")).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v): long node ids. Returns (node, component) for every node of an edge; component is the smallest id.

    Each round hangs the neighbours of a node onto their smallest one; only minima are aggregated (with partial sums on
    the map side), so a star of any size is never gathered in one task. Rounds grow with the logarithm of the number of
    nodes; each writes its edges to the shared folder, which also cuts the lineage. Null ends and loops are ignored.
    """
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(),
               "edges")
    state = _state(e)
    while state[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u")
        hung = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                .union(small.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        e = stored(hung, "edges")
        last, state = state, _state(e)
        if state == last:
            break
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
