"""Connected components of an edge table, by contraction.

Each round ranks the nodes anew by a hash with the round's seed. Every node takes the least-ranked of
itself and its neighbours, follows that choice once more, and the edges are rewritten between the
chosen nodes; inner edges vanish. As the ranks are random, whatever the ids, a round is expected to leave
a fixed part of the nodes with edges at most, also of a chain or a star, so the rounds grow with the
logarithm of their number. Each round's frames are written to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import materialize


def _ranked(node: str, turn: int) -> Column:
    return F.struct(F.xxhash64(F.lit(turn), F.col(node)).alias("rank"), F.col(node).alias("node"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is some node of its component."""
    rest = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    labels, turn = None, 0
    while not rest.isEmpty():
        turn += 1
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        choice = both.groupBy("a").agg(F.min(_ranked("b", turn)).alias("m")).select(F.col("a").alias("node"), F.least(_ranked("a", turn), "m")["node"].alias("to"))
        onward = choice.select(F.col("node").alias("to"), F.col("to").alias("then"))
        step = materialize(choice.join(onward, "to").select("node", F.col("then").alias("root")), "step")
        at_a, at_b = step.select(F.col("node").alias("a"), F.col("root").alias("ra")), step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = rest.join(at_a, "a").join(at_b, "b").filter("ra != rb")
        rest = materialize(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if labels is None:
            labels = step
        else:
            later = step.select(F.col("node").alias("root"), F.col("root").alias("now"))
            labels = materialize(labels.join(later, "root", "left").select("node", F.coalesce("now", "root").alias("root")), "labels")
    return labels if labels is not None else rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
