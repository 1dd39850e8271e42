"""From folders of source files to one graph."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.graph import Graph, empty_graph
from ..functions.settle import settle
from ..operators.merge import merge
from ..operators.rewrite import infer_copy_sinks, infer_copy_sources, link_procedures, merge_notebooks, normalize_writes, prune
from ..sources import factory, files, interpreter, sqltext

RESPONSES = "source_repo string, rel_path string, sha256 string, response string"


@dataclass(frozen=True)
class Repository:
    name: str
    path: str
    kind: str = ""


def repositories(env: dict[str, str] | None = None, siblings: list[tuple[str, str, str]] = (), fallback: str = "") -> list[Repository]:
    """From the JSON list in REPOS; else those of the sibling folders that exist; else the fallback, named default."""
    env = os.environ if env is None else env
    if listed := env.get("REPOS", "").strip():
        return [Repository(r["name"], r["path"], r.get("type", "")) for r in json.loads(listed)]
    found = [Repository(*s) for s in siblings if os.path.isdir(s[1])]
    return found or ([Repository("default", fallback)] if fallback else [])


def emissions(all_files: DataFrame, responses: DataFrame | None = None) -> Graph:
    """What the extractors say of the files. Interpreted responses serve files that need them: all Python, and SQL that the parser alone doesn't cover."""
    all_files = settle(all_files)
    parsed = sqltext.extract(all_files)
    out = parsed.union(factory.extract(all_files))
    if responses is not None:
        place = [F.col("seq.repo_idx").alias("repo_idx"), F.col("seq.path").alias("path")]
        derived = parsed.edges.filter("edge_type = 'DERIVES_FROM'").select(*place).distinct().withColumn("derived", F.lit(True))
        gated = all_files.filter("kind = 'sql'").join(derived, ["repo_idx", "path"], "left")
        gated = gated.filter(files.needs_fallback(F.col("content"), F.coalesce("derived", F.lit(False)))).select(*all_files.columns)
        said = interpreter.extract(all_files.filter("kind = 'python'").unionByName(gated), responses)
        later = lambda d: d.withColumn("seq", F.col("seq").withField("emit_idx", F.col("seq.emit_idx") + (1 << 32)))
        out = out.union(Graph(later(said.nodes), later(said.edges)))
    sqls = all_files.filter("kind = 'sql'").select("repo_idx", "path", "content")
    settled = Graph(settle(out.nodes), settle(out.edges))
    return settled.union(link_procedures(sqls, settled))


def scan_all(spark: SparkSession, repos: list[Repository]) -> DataFrame:
    """Files of all repositories that can be read, in their order; a missing folder is left out."""
    found = []
    for i, r in enumerate(repos):
        try:
            found.append(files.scan(spark, r.path, r.name, i))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    out = spark.createDataFrame([], files.FILES)
    for f in found:
        out = out.unionByName(f)
    return out


def build(spark: SparkSession, repos: list[Repository], responses: DataFrame | None = None) -> Graph:
    """The whole graph: extract, merge, prune, turn writes, join notebooks, infer copies — in this order, once, after all repositories are merged."""
    return assemble(emissions(scan_all(spark, repos), responses), {i: r.name for i, r in enumerate(repos)})


def assemble(emitted: Graph, names: dict[int, str] | None = None) -> Graph:
    nodes = emitted.nodes
    for i, name in (names or {}).items():
        here = (F.col("seq.repo_idx") == i) & (F.coalesce("source_repo", F.lit("")) == "")
        nodes = nodes.withColumn("source_repo", F.when(here, name).otherwise(F.col("source_repo")))
    graph = prune(merge(Graph(nodes, emitted.edges)))
    graph = merge_notebooks(normalize_writes(graph))
    graph = infer_copy_sinks(infer_copy_sources(Graph(settle(graph.nodes), settle(graph.edges))))
    return Graph(settle(graph.nodes), settle(graph.edges))


def analyze_directory(spark: SparkSession, path: str, source_repo: str = "", recursive: bool = True) -> Graph:
    """One folder: extracted, merged and pruned only."""
    emitted = emissions(files.scan(spark, path, source_repo, 0, recursive))
    return prune(merge(emitted))


def write_json(graph: Graph, path: str) -> None:
    graph.nodes.drop("seq").write.json(f"{path}/nodes")
    graph.edges.drop("seq").write.json(f"{path}/edges")


def read_json(spark: SparkSession, path: str) -> Graph:
    """A graph from one JSON document with nodes and edges, or from a folder that write_json made."""
    from ..functions.graph import EDGES, NODES

    own = [[f for f in s.fields if f.name != "seq"] for s in (NODES, EDGES)]
    from pyspark.sql import types as T

    schemas = [T.StructType(x) for x in own]
    if path.endswith(".json"):
        whole = spark.read.schema(T.StructType([T.StructField("nodes", T.ArrayType(schemas[0])), T.StructField("edges", T.ArrayType(schemas[1]))])).json(path, multiLine=True)
        frames = [whole.select(F.posexplode(x).alias("seq", "e")).select("e.*", "seq") for x in ("nodes", "edges")]
    else:
        frames = [spark.read.schema(s).json(f"{path}/{x}").withColumn("seq", F.monotonically_increasing_id()) for s, x in zip(schemas, ("nodes", "edges"), strict=True)]
    fill = {"transformation": "", "confidence": 1.0}
    return Graph(frames[0], frames[1].fillna(fill))


__all__ = ["Repository", "analyze_directory", "assemble", "build", "emissions", "empty_graph", "read_json", "repositories", "scan_all", "write_json"]
