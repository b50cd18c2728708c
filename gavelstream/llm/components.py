"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import stash


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """node, root for every node that a link touches; root is its component's least node.

    Each round hangs every node's larger neighbours, then its smaller ones, on
    the least node seen, until the links are stars. The links stay in Spark; a
    round tells the driver only their number and a checksum. Each node's least
    neighbour is written before the links join it, so that the join has an
    exchange of its own and Spark can split the centre of a large component. Rows with a null
    end or with equal ends link nothing.
    """
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(f"{a} != {b}").distinct()
    edges = stash(edges, "components")
    state = _state(edges)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        edges = stash(_small_star(stash(_large_star(edges), "components-large")), "components")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    stars = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("at"), F.col("lo").alias("to")).unionByName(edges.select(F.col("lo").alias("at"), F.col("hi").alias("to")))
    least = stash(both.groupBy("at").agg(F.least(F.min("to"), F.first("at")).alias("low")), "components-least")
    return both.join(least, "at").where("to > at").select(F.col("to").alias("hi"), F.col("low").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = stash(edges.groupBy("hi").agg(F.min("lo").alias("low")), "components-least")
    moved = edges.join(least, "hi").where("lo != low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("low").alias("lo"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
