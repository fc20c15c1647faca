"""Connected components of a link table, by alternating large-star and small-star rounds in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import release, stage


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One round. Each node hands the smallest node it knows to its larger (or else its smaller) neighbours."""
    a = links.select(F.col("u").alias("x"), F.col("v").alias("y"))
    b = links.select(F.col("v").alias("x"), F.col("u").alias("y"))
    known = a.unionByName(b) if large else a.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    least = known.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("k"), F.least("x", "m").alias("m"))
    told = known.join(least, F.col("x") == F.col("k"))
    told = told.where(F.col("y") > F.col("x")) if large else told
    out = told.select(F.col("y").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _print(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected_components(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``(node, root)`` for every node of ``links(u, v)``; ``root`` is its component's smallest node.

    Rounds go on until the links are stars that no longer change; the rounds
    needed grow with the logarithm of a component's diameter. Each round is a
    written table, and no list of links or members is ever held in one place.
    Self-links and repeated links do no harm; without links the result is empty.
    """
    links = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = _print(links)
    for _ in range(most_rounds if before[0] else 0):
        rows = 2 * before[0]  # a round never has more links than there are nodes and links before it
        large = stage(_stars(links, True), "large", rows)
        small = stage(_stars(large, False), "small", rows)
        now = _print(small)
        release(large)
        release(links)
        links = small
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    member = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return member.unionByName(roots)
