"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); the root is the least node.

    Large and small stars alternate until nothing changes. A node of many
    edges is aggregated map-side, and the join that follows has one row per
    node on its other side, so Spark can split it. Each round is written. Only
    a count and a checksum come to the driver.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.inline(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))

    def large(e: DataFrame) -> DataFrame:
        sym = both(e)
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return sym.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return hung.unionByName(least.select("u", F.col("m").alias("v")))

    def clean(e: DataFrame) -> DataFrame:
        return e.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now = written(clean(edges), "edges")
    seen = None
    while True:
        now = written(clean(small(large(now))), "edges")
        told = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
        if (told["n"], told["h"]) == seen:
            break
        seen = (told["n"], told["h"])
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
