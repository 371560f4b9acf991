"""Connected components of a graph given by its edges.

First each partition joins its own edges to stars; few partitions, as of a small graph, leave little
to do. Then rounds follow until all parts are stars: every node tells its larger neighbours the
smallest node it knows (large star), then its smaller ones (small star). Rows stay at one per edge at
most, and the number of rounds grows with the logarithm of the longest path. Each round is cut
off with checkpoint(), so losing an executor costs one round. Neighbours meet in partial aggregates
only, never in a list.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellex.llm.common import join_groups, use_checkpoints

#: Edges that a task joins at a time; later ones meet the stars of earlier ones.
AT_ONCE = 500_000


def _local_stars(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def stars() -> pd.DataFrame:
            pairs = [(x, root(x)) for x in list(parent)]
            parent.clear()
            return pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["a", "b"]).astype("int64")

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
            if len(parent) > AT_ONCE:
                yield stars()
        yield stars()

    return edges.mapInPandas(run, "a bigint, b bigint")


def _star(pairs: DataFrame, strict: bool) -> DataFrame:
    """Link the neighbours of each centre ``a`` (those above it, if ``strict``) to the smallest node around it."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.count("*").alias("size"))
    met = join_groups(pairs, least, "a", "size", F.col("b"))
    kept = met.where("b > a") if strict else met
    return kept.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")


def _done(edges: DataFrame) -> bool:
    """Whether every node with an edge down has one only and none leads to it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.where("down > 1 or down = 1 and up = 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of all nodes that have an edge; the component is its smallest node."""
    use_checkpoints(edges.sparkSession)
    up = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    up = _local_stars(up).distinct().checkpoint()
    while not _done(up):
        both = up.union(up.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, True).distinct().checkpoint()
        links = large.groupBy("a").agg(F.min("b").alias("b"))
        up = _star(large, False).union(links).where("a > b").distinct().checkpoint()
    return up.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        up.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
