"""Connected components by contraction, as joins and aggregates over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b) that has another node beside it; nodes of one
    component, and only these, have the same label, which is one of them.

    In each round every node goes to the node of least hash among itself and its neighbours, and the
    graph is drawn anew between these.  The hash makes the order of the nodes random, so that the
    graph shrinks by a factor in each round whatever the ids are; a star is done in one.  Each round
    is written to the shared folder, and nothing but the question whether edges are left reaches the
    driver."""
    rows = edges.where("a != b")
    left = staged(rows.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(rows.select("b", "a")), "edges")
    total = None
    while total is None or not left.isEmpty():
        step = staged(left.groupBy("src").agg(F.min(F.struct(F.xxhash64("dst").alias("h"), F.col("dst").alias("to"))).alias("near"))
                      .select("src", F.least(F.struct(F.xxhash64("src").alias("h"), F.col("src").alias("to")), "near")["to"].alias("to")), "step")
        if total is None:
            total = step.select(F.col("src").alias("node"), F.col("to").alias("label"))
        else:
            moved = step.select(F.col("src").alias("label"), "to")
            total = staged(total.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "components")
        ends = [step.select(F.col("src").alias(end), F.col("to").alias(f"{end}_to")) for end in ("src", "dst")]
        left = staged(left.join(ends[0], "src").join(ends[1], "dst").where("src_to != dst_to")
                      .select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst")).distinct(), "edges")
    return total
