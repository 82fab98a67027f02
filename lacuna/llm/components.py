"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.session import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """Label every node of ``links`` (a, b of one type) with the smallest node it can reach.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): every round links each node
    to the smallest of its neighbours, until the links are stars around the smallest nodes. Each round is
    written, so a lost executor costs a re-read. Grouped minima are combined before the shuffle and the
    joins on a node are left to adaptive skew handling, so a node with many links is no bottleneck. Only a
    count and a checksum of each round reach the driver.

    Null ends, loops and repeated links are ignored; no links give no rows. Returns (node, label).
    """
    kind = links.schema["a"].dataType
    clean = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(
        "a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    measure = dict(n="count(1)", total="bit_xor(xxhash64(a, b))")
    edges, state = scratch.write_observed(clean, f"{name}_0", **measure)
    round_ = 0
    while state["n"]:
        round_ += 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: the larger neighbours of each node move to its smallest neighbour.
        large = edges.join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(
            F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")),
                              F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")
        ).select("e.*").where("a <> b").distinct()
        following, found = scratch.write_observed(small, f"{name}_{round_}", **measure)
        scratch.drop(f"{name}_{round_ - 1}")
        edges = following
        if found == state:
            break
        state = found
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(
        edges.select(F.col("a"), F.col("a")).distinct()).select(
        F.col("node").cast(kind), F.col("label").cast(kind))
