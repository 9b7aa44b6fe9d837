"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.session import stage

_MOST_ROUNDS = 60


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Tie each node's larger (or smaller) neighbours to its least neighbour, itself included."""
    both = links.unionByName(links.selectExpr("b AS a", "a AS b"))
    if not larger:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = both.join(least, "a")
    if larger:
        return near.where("b > a AND b <> m").selectExpr("b AS a", "m AS b").distinct()
    return (
        near.where("b <> m")
        .selectExpr("b AS a", "m AS b")
        .unionByName(least.where("a <> m").selectExpr("a", "m AS b"))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component): each linked node with the least node it can reach.

    ``links`` has columns a and b, in any order. Every round is written to the
    shared folder and its predecessor read from there; a node with very many
    links is a single row of the grouped side, and the other side's rows are
    split by adaptive execution.
    """
    now = stage(
        links.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").where("a <> b").distinct(), "links"
    )
    state = None
    for _ in range(_MOST_ROUNDS):
        now = stage(_stars(_stars(now, True), False), "links")
        # done when every node has one link, to the least of its component
        row = now.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
        ).first()
        if (row["n"], row["s"]) == state:
            return now.selectExpr("a AS node", "b AS component")
        state = (row["n"], row["s"])
    raise RuntimeError("components did not settle")
