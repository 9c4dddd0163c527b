"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismark.llm.common import cut, remove


def _large(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u now hangs on the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours now hang on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node that it reaches.

    Rows with a null end and links of a node with itself are ignored; repeated links count once; an empty
    table gives an empty table. Only per-node minima are aggregated (combined before the shuffle) and joins are
    plain equi-joins that AQE may split, so a node with very many links fills no single task. Each round is
    written to the shared folder.
    """
    ends = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = cut(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
    seen = mark(edges)
    while seen[0]:
        after = cut(_small(_large(edges)), "edges")
        remove(edges)
        edges, was, seen = after, seen, mark(after)
        if was == seen:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
