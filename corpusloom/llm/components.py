"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import stage


def _links(df: DataFrame) -> DataFrame:
    return df.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``label``) for every node with an edge; the label is the smallest node.

    ``edges`` has the columns ``a`` and ``b``. A round keeps at most as many rows as
    before; a node's neighbours are never gathered, only their minimum is, and a hot
    node's rows stay spread by the join. Each round is written, so a lost executor
    costs at most one round.
    """
    links, before = stage(_links(edges.select("a", "b"))), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _links(both.join(least, "a").where("b > a").select(F.col("b").alias("a"),
                                                                   F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stage(_links(small.unionByName(low.select("a", F.col("m").alias("b")))))
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    members = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    centres = links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return members.unionByName(centres)
