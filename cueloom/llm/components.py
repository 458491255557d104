"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.checkpoints import freeze, release

#: More rounds than any graph of fewer than 2**60 nodes is expected to need.
MAX_ROUNDS = 60


def _stars(pairs: DataFrame) -> DataFrame:
    """One round: each node's larger neighbours, then its smaller ones, are hung on the least it knows of."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
    # now a > b: every row hangs a node on a smaller one
    low = large.groupBy("a").agg(F.min("b").alias("_m"))
    down = large.join(low, "a").where("b > _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return down.unionByName(low.select("a", F.col("_m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): for each node of edges (a, b), the least node reachable from it.

    Repeated edges, either direction and loops are allowed; nulls are dropped. Rounds end when every node hangs
    on one root and no root on another; each round is written to the shared folder, and
    an error is raised if they do not end within MAX_ROUNDS. The result is a written table. The least of a node's
    neighbours is summed before it is dealt out, and Spark splits a node with very many edges over tasks.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = freeze(pairs, "edges", few=True)
    mark = None
    for _ in range(MAX_ROUNDS):
        seen = pairs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
        if mark == tuple(seen) or not seen["n"]:
            break
        mark = tuple(seen)
        before, pairs = pairs, freeze(_stars(pairs), "stars", few=True)
        release(before)
    else:
        raise RuntimeError(f"components are not found in {MAX_ROUNDS} rounds")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    found = freeze(pairs.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots), "components", few=True)
    release(pairs)
    return found
