"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is an aggregation and a join on node numbers: a node with very many neighbours is
pre-aggregated for its minimum, which is then broadcast to its edges (``join_groups``), so
nothing is gathered per node. Edges and minima are written to the shared folder; a round's
tables go when the next ones are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups


def _star(edges: DataFrame, both: bool, at: Scratch, name: str) -> DataFrame:
    """Links neighbours of each node to the least of them: larger ones (both), or smaller ones and the node."""
    ab = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        ab = ab.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = ab.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    least = at.write(least, f"least-{name}")
    joined = join_groups(ab.filter("v > u") if both else ab, least, "u", "n", edges.count())
    out = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not both:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return at.write(out.filter("a <> b").distinct(), name)


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node with an edge.

    edges: bigint columns a and b in any order; loops and repeats do no harm."""
    at = Scratch(edges.sparkSession, "components")
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e, last, step = at.write(e, "e0"), None, 0
    while True:
        seen = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == last or seen[0] == 0:
            break
        last, step = seen, step + 1
        large = _star(e, True, at, f"l{step}")
        e = _star(large, False, at, f"e{step}")
        for table in (f"e{step - 1}", f"l{step}", f"least-l{step}", f"least-e{step}"):
            at.delete(table)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
