"""Factory artefacts (pipelines, datasets, dataflows in JSON) to emissions, by explicit schemas and JSON functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graph import Graph, file_id, last_part, meta, no_meta

REF = "struct<referenceName:string,name:string>"
PROPS = f"struct<pipeline:{REF},dataflow:{REF},notebookPath:string,pythonFile:string,baseParameters:struct<target_table:string>,storedProcedureName:string,procedureName:string>"
ACTIVITY = f"struct<name:string,type:string,inputs:array<{REF}>,outputs:array<{REF}>,typeProperties:{PROPS}>"
FLOW_END = f"array<struct<name:string,dataset:{REF}>>"
BODY = f"activities:array<{ACTIVITY}>,typeProperties:struct<tableName:string,`table`:string,fileName:string,schema:string,sources:{FLOW_END},sinks:{FLOW_END}>"
DOC = f"struct<name:string,properties:struct<{BODY}>,{BODY}>"
#: Activity types.
NOTEBOOKS = ("DatabricksNotebook", "DatabricksPythonActivity", "AzureDatabricksActivity")
PROCEDURES = ("SqlServerStoredProcedure", "StoredProcedure")
DATAFLOWS = ("MappingDataFlow", "ExecuteDataFlow")


def ref(col: str) -> Column:
    return F.coalesce(F.col(col)["referenceName"], F.col(col)["name"])


class Emissions:
    """Collects node and edge selections over rows that have source_repo, repo_idx, path and an order column `at`."""

    def __init__(self):
        self.nodes: list[DataFrame] = []
        self.edges: list[DataFrame] = []

    @staticmethod
    def _seq(k: int) -> Column:
        return F.struct(F.col("repo_idx").cast("int").alias("repo_idx"), F.col("path").alias("path"), (F.col("at") * 64 + k).cast("long").alias("emit_idx")).alias("seq")

    def node(self, rows: DataFrame, id_: Column, name: Column, kind: str | Column, metadata: Column | None = None) -> None:
        k = len(self.nodes) + len(self.edges)
        kind = kind if isinstance(kind, Column) else F.lit(kind)
        out = rows.select(id_.alias("id"), name.alias("name"), kind.alias("node_type"), F.col("source_repo"), (no_meta() if metadata is None else metadata).alias("metadata"), self._seq(k))
        self.nodes.append(out.filter("id is not null"))

    def edge(self, rows: DataFrame, source: Column, target: Column, kind: str | Column, note: Column | str = "", confidence: float = 1.0, metadata: Column | None = None) -> None:
        k = len(self.nodes) + len(self.edges)
        note = note if isinstance(note, Column) else F.lit(note)
        kind = kind if isinstance(kind, Column) else F.lit(kind)
        out = rows.select(source.alias("source_id"), target.alias("target_id"), kind.alias("edge_type"), note.alias("transformation"), F.lit(confidence).alias("confidence"), (no_meta() if metadata is None else metadata).alias("metadata"), self._seq(k))
        self.edges.append(out.filter("source_id is not null and target_id is not null"))

    def graph(self) -> Graph:
        return Graph(reduce(DataFrame.unionByName, self.nodes), reduce(DataFrame.unionByName, self.edges))


def extract(files: DataFrame) -> Graph:
    """Emissions of factory files (see sources.files). Text that is no JSON gives nothing."""
    docs = files.filter("kind = 'factory'").withColumn("doc", F.from_json(F.regexp_replace("content", r'"dataFlow"\s*:', '"dataflow":'), DOC)).filter("get_json_object(content, '$') is not null and doc is not null")
    stem = F.regexp_replace(F.element_at("path", -1), r"\.[^.]*$", "")
    body = lambda x: F.coalesce(F.col("doc.properties")[x], F.col("doc")[x])
    docs = docs.withColumns({"name": F.coalesce(F.nullif("doc.name", F.lit("")), stem), "file": file_id(F.col("source_repo"), F.col("rel_path")), "activities": body("activities"), "props": body("typeProperties"), "at": F.lit(0)})
    base = ["repo_idx", "source_repo", "path", "name", "file", "props", "at"]
    e = Emissions()
    _pipelines(e, docs.filter("folder = 'pipeline'"))
    _datasets(e, docs.filter("folder = 'dataset'").select(*base))
    _dataflows(e, docs.filter("folder = 'dataflow'").select(*base))
    return e.graph()


def _pipelines(e: Emissions, docs: DataFrame) -> None:
    own = F.concat(F.lit("adf.pipeline."), F.col("name"))
    e.node(docs, own, F.col("name"), "ADF_PIPELINE", meta(file=F.col("file")))
    e.node(docs, F.col("file"), F.element_at("path", -1), "FILE")
    e.edge(docs, own, F.col("file"), "DEFINED_IN")
    acts = docs.select("repo_idx", "source_repo", "path", own.alias("own"), F.posexplode("activities").alias("at", "a")).withColumn("at", F.col("at") + 1)
    acts = acts.select("*", F.col("a.name").alias("act"), F.col("a.type").alias("kind"), F.col("a.typeProperties").alias("p"))
    dataset = lambda c: F.concat(F.lit("adf.dataset."), c)
    copies = acts.filter("kind = 'Copy'").select("*", F.transform("a.inputs", lambda x: F.coalesce(x["referenceName"], x["name"])).alias("ins"), F.transform("a.outputs", lambda x: F.coalesce(x["referenceName"], x["name"])).alias("outs"))
    note = F.concat(F.lit("Copy("), F.coalesce("act", F.lit("")), F.lit(")"))
    for column, kind in (("ins", "READS_FROM"), ("outs", "WRITES_TO")):
        ends = copies.withColumn("end", F.explode(column))
        e.node(ends, dataset(F.col("end")), F.col("end"), "ADF_DATASET")
        e.edge(ends, F.col("own"), dataset(F.col("end")), kind)
    both = copies.withColumn("i", F.explode("ins")).withColumn("o", F.explode("outs"))  # within one activity
    e.edge(both, dataset(F.col("i")), dataset(F.col("o")), "COPIES_TO", note)
    calls = ((("ExecutePipeline",), ref("p.pipeline"), "adf.pipeline.", "ADF_PIPELINE"), (DATAFLOWS, ref("p.dataflow"), "adf.dataflow.", "ADF_DATAFLOW"))
    for kinds, name, prefix, node in calls:
        rows = acts.filter(F.col("kind").isin(*kinds)).withColumn("to", name).filter("to <> ''")
        e.node(rows, F.concat(F.lit(prefix), F.col("to")), F.col("to"), node)
        e.edge(rows, F.col("own"), F.concat(F.lit(prefix), F.col("to")), "TRIGGERS")
    notebooks = acts.filter(F.col("kind").isin(*NOTEBOOKS)).withColumn("to", F.coalesce(F.nullif("p.notebookPath", F.lit("")), "p.pythonFile")).filter("to <> ''")
    e.node(notebooks, F.col("to"), F.element_at(F.split("to", "/"), -1), "FILE", meta(source="adf-notebook", path=F.col("to")))
    e.edge(notebooks, F.col("own"), F.col("to"), "TRIGGERS", F.concat(F.lit("Notebook("), F.coalesce("act", F.lit("")), F.lit(")")))
    written = notebooks.withColumn("tbl", F.lower(last_part(F.col("p.baseParameters.target_table")))).filter("tbl <> ''")
    e.edge(written, F.col("to"), F.col("tbl"), "WRITES_TO", F.concat(F.lit("Notebook("), F.coalesce("act", F.lit("")), F.lit(") → "), F.col("p.baseParameters.target_table")))
    procs = acts.filter(F.col("kind").isin(*PROCEDURES)).withColumn("full", F.coalesce(F.nullif("p.storedProcedureName", F.lit("")), "p.procedureName")).withColumn("to", F.lower(last_part(F.col("full")))).filter("to <> ''")
    e.node(procs, F.col("to"), F.col("to"), "PROCEDURE", meta(source="adf-procedure", adf_reference=F.col("full")))
    e.edge(procs, F.col("own"), F.col("to"), "TRIGGERS", F.concat(F.lit("StoredProcedure("), F.coalesce("act", F.lit("")), F.lit(")")))


def _datasets(e: Emissions, docs: DataFrame) -> None:
    own = F.concat(F.lit("adf.dataset."), F.col("name"))
    e.node(docs, own, F.col("name"), "ADF_DATASET", meta(file=F.concat_ws("/", "path")))
    filled = lambda x: F.nullif(F.col(f"props.{x}"), F.lit(""))
    backed = docs.withColumn("tbl", F.coalesce(filled("tableName"), filled("table"), filled("fileName"))).filter("tbl is not null")
    e.node(backed, F.lower("tbl"), F.col("tbl"), "TABLE", meta(resolved_from=own, schema=filled("schema")))
    e.edge(backed, own, F.lower("tbl"), "READS_FROM", "ADF dataset → physical table")


def _dataflows(e: Emissions, docs: DataFrame) -> None:
    own = F.concat(F.lit("adf.dataflow."), F.col("name"))
    e.node(docs, own, F.col("name"), "ADF_DATAFLOW", meta(file=F.concat_ws("/", "path")))
    for part, kind in (("sources", "READS_FROM"), ("sinks", "WRITES_TO")):
        ends = docs.withColumn("d", F.explode(F.col("props")[part])).withColumn("end", ref("d.dataset")).filter("end <> ''")
        e.edge(ends, own, F.concat(F.lit("adf.dataset."), F.col("end")), kind)
