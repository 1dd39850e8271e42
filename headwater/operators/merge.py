"""Merging emissions by key, keeping the best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.graph import EDGE_KEY, Graph, origin


def merge_nodes(emitted: DataFrame) -> DataFrame:
    """One node per id: the first that is not interpreted, else the first; its place is that of the id's first emission. One aggregation, combined on the map side."""
    rest = [x for x in emitted.columns if x not in ("id", "seq")]
    best = F.min_by(F.struct(*rest), F.struct((origin() == "llm").alias("interpreted"), "seq"))
    merged = emitted.groupBy("id").agg(best.alias("best"), F.min("seq").alias("seq"))
    return merged.select("id", *[F.col("best")[x].alias(x) for x in rest], "seq")


def merge_edges(emitted: DataFrame) -> DataFrame:
    """One edge per source, target and type: the most confident, of those the first; its place is that of the key's first emission."""
    rest = [x for x in emitted.columns if x not in (*EDGE_KEY, "seq")]
    best = F.min_by(F.struct(*rest), F.struct((-F.col("confidence")).alias("doubt"), "seq"))
    merged = emitted.groupBy(*EDGE_KEY).agg(best.alias("best"), F.min("seq").alias("seq"))
    return merged.select(*EDGE_KEY, *[F.col("best")[x].alias(x) for x in rest], "seq")


def merge(graph: Graph) -> Graph:
    return Graph(merge_nodes(graph.nodes), merge_edges(graph.edges))

