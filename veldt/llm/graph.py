"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import forget, materialize


def _large(e: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest node of its neighbourhood."""
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them. e: a > b."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """edges (a, b) of long ids, in any direction -> (id, component) for each id that is not the smallest of its own.

    Every round is written to the shared folder, in place of the one before; only counts and a checksum come to the driver. When a round changes
    nothing, each edge leads from a node to the smallest id of its component. Ids with a null end are left out.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    e, before = materialize(e, "edges"), None
    for _ in range(most_rounds):
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or now[0] == 0:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
        old, before, e = e, now, materialize(_small(_large(e)), "edges")
        forget(old)
    raise RuntimeError("components did not settle")
