"""Connected components over an edge table, by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component.

    edges holds two long columns a, b; loops and repeated links are allowed. In each round every
    node hooks onto its smallest neighbour, parents are doubled twice, and the links move to the
    parents; loops vanish. Minima are partial aggregates and links are joined, never gathered, so
    a hub costs no task more than its share. Each round's tables are written to the shared folder.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return (
            df.where("a != b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )

    links = materialize(tidy(edges), "links")
    roots = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("root")
        )
        hooks = materialize(hooks, "hooks")
        for _ in range(2):
            doubled = materialize(_doubled(hooks), "hooks")
            discard(hooks)
            hooks = doubled
        ends = [hooks.select(F.col("node").alias(c), F.col("root").alias(f"to_{c}")) for c in "ab"]
        moved = links.join(ends[0], "a").join(ends[1], "b").select(
            F.col("to_a").alias("a"), F.col("to_b").alias("b")
        )
        before, links = links, materialize(tidy(moved), "links")
        discard(before)
        if roots is None:
            roots = hooks
        else:
            step = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            before, roots = roots, materialize(
                roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")),
                "roots",
            )
            discard(before, hooks)
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    discard(links)
    return roots


def _doubled(hooked: DataFrame) -> DataFrame:
    """Every node takes its parent's parent."""
    upper = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return hooked.join(upper, "root").select("node", F.col("next").alias("root"))
