"""Connected components by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchwork.plans.session import discard, materialize


def _hooked(directed: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours hang on the least of them, written. The minima are written first, so that
    the join has an exchange on either side and a node of very many links can be split."""
    least = materialize(directed.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = directed.join(least, "u")
    if large:
        hung = joined.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:
        rest = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = rest.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
    out = materialize(hung.distinct(), "edges")
    discard(least)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """`edges` has integer columns u and v. One row (id, component) for each node of an edge,
    the component named by its least node. Self-loops and nulls are dropped, repeats are harmless."""

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    down = materialize(down, "edges")
    seen = state(down)
    while True:
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = _hooked(both, large=True)
        before, down = down, _hooked(wide, large=False)
        discard(before, wide)
        now = state(down)
        if now == seen:
            break
        seen = now
    roots = down.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return down.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
