"""The graph's two relations, their schemas and the rules of their ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of nodes and edges.
NODE_TYPES = ("TABLE", "VIEW", "COLUMN", "PROCEDURE", "PYTHON_FUNCTION", "FILE", "ADF_PIPELINE", "ADF_DATASET", "ADF_DATAFLOW")
EDGE_TYPES = ("HAS_COLUMN", "DERIVES_FROM", "READS_FROM", "WRITES_TO", "DEFINED_IN", "COPIES_TO", "TRIGGERS")
TABLE_LIKE = ("TABLE", "VIEW")
#: Nodes that stay even if nothing links to them.
PROTECTED = ("FILE", "PROCEDURE", "PYTHON_FUNCTION", "ADF_PIPELINE", "ADF_DATASET", "ADF_DATAFLOW")
ALIAS_MARK = "ADF dataset"
COPY_NOTE = "1:1 ADF copy (inferred)"
COPY_CONFIDENCE, INTERPRETED_CONFIDENCE = 0.9, 0.85

METADATA = T.MapType(T.StringType(), T.StringType())
#: Where an emission stands: merging keeps the first. Rows of a repository, its paths by component, then order in the file.
SEQ = T.StructType([T.StructField("repo_idx", T.IntegerType()), T.StructField("path", T.ArrayType(T.StringType())), T.StructField("emit_idx", T.LongType())])
NODES = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "node_type", "source_repo")] + [T.StructField("metadata", METADATA), T.StructField("seq", SEQ)])
EDGES = T.StructType([T.StructField(n, T.StringType()) for n in ("source_id", "target_id", "edge_type", "transformation")] + [T.StructField("confidence", T.DoubleType()), T.StructField("metadata", METADATA), T.StructField("seq", SEQ)])
EDGE_KEY = ["source_id", "target_id", "edge_type"]


@dataclass(frozen=True)
class Graph:
    """nodes: id, name, node_type, source_repo, metadata, seq; edges: source_id, target_id, edge_type, transformation, confidence, metadata, seq. seq may have any type that orders."""

    nodes: DataFrame
    edges: DataFrame

    def union(self, other: Graph) -> Graph:
        return Graph(self.nodes.unionByName(other.nodes), self.edges.unionByName(other.edges))


def empty_graph(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))


def origin() -> Column:
    """What made a node; maps can't be keys, so this is what keyed work uses."""
    return F.coalesce(F.col("metadata")["source"], F.lit(""))


def meta(**values: Column | str) -> Column:
    parts = [x for k, v in values.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]
    return F.map_filter(F.create_map(*parts), lambda _, v: v.isNotNull()) if parts else F.create_map().cast(METADATA)


def no_meta() -> Column:
    return F.create_map().cast(METADATA)


def last_part(col: Column, sep: str = "[.]") -> Column:
    return F.element_at(F.split(col, sep), -1)


def file_id(repo: Column, rel_path: Column) -> Column:
    return F.when(F.coalesce(repo, F.lit("")) == "", rel_path).otherwise(F.concat_ws("/", repo, rel_path))


def basename(col: Column) -> Column:
    return F.lower(F.element_at(F.split(F.regexp_replace(col, r"\\", "/"), "/"), -1))
