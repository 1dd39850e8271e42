"""Structured responses of an interpreter, for code that no parser covers, to emissions.

Nothing is called over a network here: a provider puts (source_repo, rel_path, sha256, response) rows into a table, and they
are joined to files by content. A response is JSON of the form below, perhaps within Markdown fences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.graph import INTERPRETED_CONFIDENCE, Graph, file_id, meta
from .factory import Emissions

RESPONSE = "struct<tables:array<struct<name:string,type:string>>,columns:array<struct<target_table:string,target_column:string,source_table:string,source_column:string,transformation:string>>,data_flows:array<struct<source:string,target:string,operation:string>>>"
#: An operation that holds one of these writes.
WRITES = ("to_sql", "insert", "saveastable", "write", "writeto", "writes_to", "df.to_", "spark.write", "savemode")
OTHER_TABLES = ("VIEW", "PROCEDURE", "PYTHON_FUNCTION")


def writes(operation):
    low = F.lower(F.coalesce(operation, F.lit("")))
    found = F.lit(False)
    for w in WRITES:
        found = found | low.contains(w)
    return found


def parsed(responses: DataFrame) -> DataFrame:
    """responses with `r`, the response's struct; null where it is no JSON object, or where a table has no name, or a table's type or a part of a flow is null: such a file gives nothing."""
    bare = F.regexp_replace(F.trim("response"), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    r = F.when(bare.rlike(r"(?s)^\{.*\}$"), F.from_json(bare, RESPONSE))
    whole = ~F.exists(F.coalesce("r.tables", F.array().cast("array<struct<name:string,type:string>>")), lambda t: t["name"].isNull())
    ends = ~bare.rlike(r'"(source|target|operation|type)"\s*:\s*null')
    return responses.withColumn("r", r).withColumn("r", F.when(whole & ends, F.col("r")))


def extract(files: DataFrame, responses: DataFrame) -> Graph:
    """Emissions of the files that have a response for their very content."""
    rows = files.join(parsed(responses).select("source_repo", "rel_path", "sha256", "r"), ["source_repo", "rel_path", "sha256"]).filter("r is not null")
    rows = rows.withColumns({"file": file_id(F.col("source_repo"), F.col("rel_path")), "at": F.lit(0)}).select("repo_idx", "source_repo", "path", "rel_path", "file", "at", "r")
    e = Emissions()
    e.node(rows, F.col("file"), F.element_at("path", -1), "FILE", meta(path=F.col("rel_path")))
    base = ["repo_idx", "source_repo", "path", "rel_path", "file"]
    tables = rows.select(*base, F.posexplode("r.tables").alias("at", "t")).select(*base, "at", F.lower("t.name").alias("tbl"), F.upper("t.type").alias("type")).filter("tbl <> ''")
    kind = F.when(F.col("type").isin(*OTHER_TABLES), F.col("type")).otherwise("TABLE")
    e.node(tables, F.col("tbl"), F.col("tbl"), kind, meta(source="llm", file=F.col("rel_path")))
    e.edge(tables, F.col("tbl"), F.col("file"), "DEFINED_IN")
    low = lambda x: F.lower(f"c.{x}").alias(x)
    parts = ("target_table", "target_column", "source_table", "source_column")
    cols = rows.select(*base, F.posexplode("r.columns").alias("at", "c")).select(*base, "at", *map(low, parts), F.coalesce("c.transformation", F.lit("")).alias("how"))
    for p in parts:
        cols = cols.filter(F.coalesce(p, F.lit("")) != "")
    cols = cols.withColumns({"to": F.concat_ws(".", "target_table", "target_column"), "of": F.concat_ws(".", "source_table", "source_column"), "at": F.col("at") + 100_000})
    for owner, col, name in (("target_table", "to", "target_column"), ("source_table", "of", "source_column")):
        e.node(cols, F.col(col), F.col(name), "COLUMN", meta(source="llm", table=F.col(owner)))
        e.edge(cols, F.col(owner), F.col(col), "HAS_COLUMN")
    e.edge(cols, F.col("to"), F.col("of"), "DERIVES_FROM", F.col("how"), INTERPRETED_CONFIDENCE, meta(source="llm"))
    flows = rows.select(*base, "r", F.posexplode("r.data_flows").alias("at", "f")).select(*base, "r", (F.col("at") + 200_000).alias("at"), F.lower("f.source").alias("s"), F.lower("f.target").alias("t"), F.coalesce("f.operation", F.lit("")).alias("op")).filter("s <> '' and t <> ''")
    named = lambda kinds: F.transform(F.filter(F.coalesce("r.tables", F.array().cast("array<struct<name:string,type:string>>")), kinds), lambda x: F.lower(x["name"]))
    functions, known = named(lambda x: F.upper(x["type"]) == "PYTHON_FUNCTION"), named(lambda x: F.lit(True))
    flows = flows.withColumns({"fs": functions, "known": known}).filter(~(F.array_contains("fs", F.col("s")) & F.array_contains("fs", F.col("t")))).drop("r")
    for end in ("s", "t"):
        e.node(flows.filter(~F.array_contains("known", F.col(end))), F.col(end), F.col(end), "TABLE", meta(source="llm", file=F.col("rel_path")))
    out = writes(F.col("op"))
    e.edge(flows, F.when(out, F.col("s")).otherwise(F.col("t")), F.when(out, F.col("t")).otherwise(F.col("s")), F.when(out, "WRITES_TO").otherwise("READS_FROM"), F.col("op"), INTERPRETED_CONFIDENCE, meta(source="llm"))
    return e.graph()
