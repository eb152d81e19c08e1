"""Connected components of an edge list by alternating large and small stars.

Each round links every node's larger neighbours (then its smaller ones) to the least
node it knows, so components become stars in a logarithmic number of rounds. Rounds
are written to the shared folder, never gathered on the driver; only two numbers a
round are, to see whether anything changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with v < u; the result again."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("of", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("of"))
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.filter("of != m").select(F.col("of").alias("u"), F.col("m").alias("v"))
        moved = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return moved.filter("u != v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (x, y) but the roots themselves; root is the least node of the component."""
    now = materialise(edges.filter("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = materialise(_star(_star(now, True), False), "stars")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
