"""Queries of the graph operators over a graph derived from the test tables, with their SQL.

The graph's emissions are SQL that both engines run; each query applies an operator to them, and its SQL says the same with
joins and windows. Ties are broken by values, so results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.graph import Graph, basename
from ..operators import diff as D
from ..operators import merge as M
from ..operators import rewrite as R
from ..operators import traverse as T
from ..sources import factory, interpreter, sqltext
from ..sources import files as S
from .review import MOST_EDGES, first_rows

NODES_SQL = """
SELECT 'region.' || CAST(r_regionkey AS STRING) AS id, r_name AS name, 'ADF_PIPELINE' AS node_type, '' AS origin, 1 AS rank FROM region
UNION ALL SELECT 'nation.' || CAST(n_nationkey AS STRING), n_name, 'ADF_DATASET', '', 1 FROM nation
UNION ALL SELECT 'customer.' || CAST(c_custkey AS STRING), c_name, 'TABLE', CASE WHEN c_mktsegment = 'MACHINERY' THEN 'llm' ELSE '' END, 2 FROM customer
UNION ALL SELECT 'customer.' || CAST(o_custkey AS STRING), 'ordered ' || o_orderpriority, 'TABLE', 'llm', 1 FROM orders
UNION ALL SELECT 'supplier.' || CAST(s_suppkey AS STRING), s_name, 'TABLE', '', 1 FROM supplier
UNION ALL SELECT 'part.' || CAST(p_partkey AS STRING), p_name, 'TABLE', '', 1 FROM part
UNION ALL SELECT 'order.' || CAST(o_orderkey AS STRING), o_orderstatus, 'VIEW', CASE WHEN o_orderstatus = 'P' THEN 'llm' ELSE '' END, 1 FROM orders
UNION ALL SELECT 'order.' || CAST(l_orderkey AS STRING) || '.l' || CAST(l_linenumber AS STRING), l_returnflag || l_linestatus, 'COLUMN', '', 1 FROM lineitem
UNION ALL SELECT 'file.' || CAST(year(o_orderdate) AS STRING), 'orders', 'FILE', '', 1 FROM orders
"""
EDGES_SQL = """
SELECT 'order.' || CAST(l_orderkey AS STRING) AS source_id, 'order.' || CAST(l_orderkey AS STRING) || '.l' || CAST(l_linenumber AS STRING) AS target_id,
  'HAS_COLUMN' AS edge_type, '' AS transformation, CAST(1.0 AS DOUBLE) AS confidence FROM lineitem
UNION ALL SELECT 'order.' || CAST(l_orderkey AS STRING) || '.l' || CAST(l_linenumber AS STRING), 'part.' || CAST(l_partkey AS STRING), 'DERIVES_FROM', l_returnflag || '(' || l_linestatus || ')',
  CAST(CASE WHEN l_discount = 0 THEN 1.0 WHEN l_discount < 0.05 THEN 0.9 ELSE 0.85 END AS DOUBLE) FROM lineitem
UNION ALL SELECT 'order.' || CAST(o_orderkey AS STRING), 'customer.' || CAST(o_custkey AS STRING), 'READS_FROM', o_orderpriority, CAST(1.0 AS DOUBLE) FROM orders WHERE o_orderstatus <> 'O' OR o_orderdate < TIMESTAMP '1998-01-01 00:00:00'
UNION ALL SELECT 'nation.' || CAST(n_nationkey AS STRING), 'region.' || CAST(n_regionkey AS STRING), 'READS_FROM', 'ADF dataset of ' || n_name, CAST(1.0 AS DOUBLE) FROM nation
UNION ALL SELECT 'supplier.' || CAST(l_suppkey AS STRING), 'part.' || CAST(l_partkey AS STRING), 'WRITES_TO', l_linestatus,
  CAST(CASE WHEN l_discount = 0 THEN 1.0 WHEN l_discount < 0.05 THEN 0.9 ELSE 0.85 END AS DOUBLE) FROM lineitem
UNION ALL SELECT 'part.' || CAST(l_partkey AS STRING), 'supplier.' || CAST(l_suppkey AS STRING), 'READS_FROM', 'stock', CAST(1.0 AS DOUBLE) FROM lineitem WHERE l_quantity > 45
UNION ALL SELECT 'nation.' || CAST(c_nationkey AS STRING), 'customer.' || CAST(c_custkey AS STRING), 'COPIES_TO', 'Copy(' || c_mktsegment || ')', CAST(0.9 AS DOUBLE) FROM customer WHERE c_acctbal > 0
UNION ALL SELECT 'region.' || CAST(n_regionkey AS STRING), 'nation.' || CAST(n_nationkey AS STRING), 'TRIGGERS', '', CAST(1.0 AS DOUBLE) FROM nation
UNION ALL SELECT 'order.' || CAST(o_orderkey AS STRING), 'file.' || CAST(year(o_orderdate) AS STRING), 'DEFINED_IN', '', CAST(1.0 AS DOUBLE) FROM orders
"""
COPY_NODES_SQL = """
SELECT 'ds.region.' || CAST(r_regionkey AS STRING) AS id, 'ADF_DATASET' AS node_type, r_name AS name FROM region
UNION ALL SELECT 'ds.nation.' || CAST(n_nationkey AS STRING), 'ADF_DATASET', n_name FROM nation
UNION ALL SELECT 'ds.supplier.' || CAST(s_suppkey AS STRING), 'ADF_DATASET', s_name FROM supplier
"""
COPY_EDGES_SQL = """
SELECT 'ds.region.' || CAST(n_regionkey AS STRING) AS source_id, 'ds.nation.' || CAST(n_nationkey AS STRING) AS target_id, 'COPIES_TO' AS edge_type, 'Copy' AS transformation FROM nation
UNION ALL SELECT 'ds.nation.' || CAST(n_nationkey AS STRING), 'nation_t' || CAST(n_nationkey AS STRING), 'READS_FROM', 'ADF dataset of a table' FROM nation
UNION ALL SELECT DISTINCT 'nation_t' || CAST(c_nationkey AS STRING), 'nation_t' || CAST(c_nationkey AS STRING) || '.' || lower(c_mktsegment), 'HAS_COLUMN', '' FROM customer
UNION ALL SELECT 'ds.nation.' || CAST(s_nationkey AS STRING), 'ds.supplier.' || CAST(s_suppkey AS STRING), 'COPIES_TO', 'Copy' FROM supplier
UNION ALL SELECT 'ds.supplier.' || CAST(s_suppkey AS STRING), 'supplier_t' || CAST(s_suppkey AS STRING), 'READS_FROM', 'ADF dataset of a table' FROM supplier
"""
FILES_SQL = """
SELECT doc_id, source || '/' || CASE WHEN lang = 'de' THEN 'Pipeline/' WHEN lang = 'fr' THEN 'dataset/' WHEN lang = 'es' THEN 'linkedService/' ELSE '' END || 'f' || CAST(doc_id AS STRING)
  || CASE WHEN lang <> 'en' THEN '.json' WHEN source = 'src1' THEN '.SQL' WHEN source = 'src2' THEN '.hql' WHEN source = 'src3' THEN '.py' WHEN source = 'src4' THEN '.pyspark' WHEN source = 'src5' THEN '.txt' ELSE '.ddl' END AS rel_path,
  source AS source_repo, text AS content FROM documents
"""
PROC_SQL = """
SELECT doc_id, lang, 'CREATE OR REPLACE ' || CASE WHEN lang = 'de' THEN 'FUNCTION' ELSE 'procedure' END || ' app."P' || CAST(doc_id AS STRING) || '" AS ' || text
  || ' INSERT INTO dw.t_' || source || ' (Doc_Id, "Lang", n_chars) SELECT 1; INSERT INTO t_' || source || ' (other) SELECT 2' AS content, 't_' || source AS tbl, source FROM documents
"""


def views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names}


def said(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the statements above over the tables of sf_dir."""
    known = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "pages")
    import re

    used = [t for t in known if re.search(rf"\bFROM {t}\b|\bJOIN {t}\b", sql)]
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **views(spark, sf_dir, *used))


def with_meta(df: DataFrame, seq: list) -> DataFrame:
    source = F.when(F.col("origin") != "", F.create_map(F.lit("source"), F.col("origin"))).otherwise(F.create_map().cast("map<string,string>")) if "origin" in df.columns else F.create_map().cast("map<string,string>")
    return df.withColumns({"metadata": source, "seq": F.struct(*seq)})


def emitted(spark: SparkSession, sf_dir: str) -> Graph:
    nodes = with_meta(said(spark, sf_dir, NODES_SQL), ["rank", "name"]).select("id", "name", "node_type", F.lit("").alias("source_repo"), "metadata", "seq")
    edges = with_meta(said(spark, sf_dir, EDGES_SQL), ["transformation"]).select("source_id", "target_id", "edge_type", "transformation", "confidence", "metadata", "seq")
    return Graph(nodes, edges)


def merged(spark: SparkSession, sf_dir: str) -> Graph:
    return M.merge(emitted(spark, sf_dir))


def copies(spark: SparkSession, sf_dir: str) -> Graph:
    nodes = with_meta(said(spark, sf_dir, COPY_NODES_SQL), ["id"]).select("id", "name", "node_type", F.lit("").alias("source_repo"), "metadata", "seq")
    edges = with_meta(said(spark, sf_dir, COPY_EDGES_SQL), ["source_id", "target_id"]).select("source_id", "target_id", "edge_type", "transformation", F.lit(1.0).alias("confidence"), "metadata", "seq")
    return Graph(nodes, edges)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[Graph, Graph]:
    """Before: the confident emissions; after: the emissions without one kind of line."""
    g = emitted(spark, sf_dir)
    before = Graph(M.merge_nodes(g.nodes.filter("name <> 'NF'")), M.merge_edges(g.edges.filter("confidence > 0.85")))
    after = Graph(M.merge_nodes(g.nodes.filter("name <> 'AF'")), M.merge_edges(g.edges.filter("transformation <> 'A(F)'")))
    return before, after


NODE_COLS = ["id", "name", "node_type", "origin"]
EDGE_COLS = ["source_id", "target_id", "edge_type", "transformation", "confidence"]


def _nodes(df: DataFrame) -> DataFrame:
    return df.select("id", "name", "node_type", F.coalesce(F.col("metadata")["source"], F.lit("")).alias("origin"))


E_CTE = f"e AS ({EDGES_SQL})"
N_CTE = f"n AS ({NODES_SQL})"
MERGED_NODES = "mn AS MATERIALIZED (SELECT id, name, node_type, origin FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN origin = 'llm' THEN 1 ELSE 0 END, rank, name) AS k FROM n) WHERE k = 1)"
MERGED_EDGES = "me AS MATERIALIZED (SELECT source_id, target_id, edge_type, transformation, confidence FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, edge_type ORDER BY confidence DESC, transformation) AS k FROM e) WHERE k = 1)"
BOTH = f"{N_CTE}, {E_CTE}, {MERGED_NODES}, {MERGED_EDGES}"
PROTECTED_SQL = "('FILE', 'PROCEDURE', 'PYTHON_FUNCTION', 'ADF_PIPELINE', 'ADF_DATASET', 'ADF_DATAFLOW')"


def round_sql(k: int) -> str:
    """Round k of pruning: n{k}, e{k} from n{k-1}, e{k-1}."""
    a, b = f"n{k - 1}", f"e{k - 1}"
    return f"""x{k} AS MATERIALIZED (SELECT id, bool_or(linked) AS linked, bool_or(owns) AS owns FROM (SELECT source_id AS id, edge_type <> 'DEFINED_IN' AS linked, edge_type = 'HAS_COLUMN' AS owns FROM {b} UNION ALL SELECT target_id, TRUE, FALSE FROM {b}) GROUP BY id),
    d{k} AS MATERIALIZED (SELECT a.id FROM {a} a LEFT JOIN x{k} x ON x.id = a.id WHERE node_type NOT IN {PROTECTED_SQL} AND (NOT coalesce(linked, FALSE) OR (node_type = 'TABLE' AND origin = 'llm' AND NOT coalesce(owns, FALSE)))),
    n{k} AS MATERIALIZED (SELECT a.* FROM {a} a ANTI JOIN d{k} d ON d.id = a.id),
    e{k} AS MATERIALIZED (SELECT b.* FROM {b} b ANTI JOIN d{k} s ON s.id = b.source_id ANTI JOIN d{k} t ON t.id = b.target_id)"""


PRUNED = f"WITH {BOTH}, n0 AS (SELECT * FROM mn), e0 AS (SELECT * FROM me), " + ", ".join(round_sql(k) for k in range(1, 7))


def hops_sql(edges: str, down: bool) -> str:
    """(src, dst, edge) in the direction of the walk."""
    src, dst = ("producer", "consumer") if down else ("consumer", "producer")
    back = "source_id AS src, target_id AS dst" if down else "target_id AS src, source_id AS dst"
    return f"""f AS (SELECT *, CASE WHEN edge_type IN ('DERIVES_FROM', 'READS_FROM') THEN source_id ELSE target_id END AS consumer,
      CASE WHEN edge_type IN ('DERIVES_FROM', 'READS_FROM') THEN target_id ELSE source_id END AS producer FROM {edges} WHERE edge_type IN ('DERIVES_FROM', 'READS_FROM', 'WRITES_TO', 'COPIES_TO')),
    h AS (SELECT {src} AS src, {dst} AS dst, source_id, target_id, edge_type FROM f
      UNION ALL SELECT {back}, source_id, target_id, edge_type FROM {edges} WHERE edge_type = 'READS_FROM' AND transformation LIKE '%ADF dataset%')"""


def reach_sql(down: bool, seeds: str, depth: int) -> str:
    return f"""WITH RECURSIVE {BOTH}, {hops_sql("me", down)}, hd AS (SELECT DISTINCT src, dst FROM h),
    r(id, depth) AS (SELECT id, 0 FROM ({seeds}) UNION SELECT hd.dst, r.depth + 1 FROM r JOIN hd ON hd.src = r.id WHERE r.depth < {depth}),
    s AS (SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY id)"""


UP_SEEDS = "SELECT id FROM mn WHERE node_type = 'VIEW' AND origin = 'llm'"
DOWN_SEEDS = "SELECT id FROM mn WHERE node_type = 'ADF_PIPELINE'"
START = "part.1"


def merge_nodes(spark, sf_dir):
    return _nodes(merged(spark, sf_dir).nodes)


def merge_edges(spark, sf_dir):
    return merged(spark, sf_dir).edges.select(*EDGE_COLS)


def prune_round1(spark, sf_dir):
    g = merged(spark, sf_dir)
    return R.dead_nodes(g.nodes, g.edges)


def prune_fixpoint(spark, sf_dir):
    return _nodes(R.prune(merged(spark, sf_dir)).nodes)


def normalize_writes(spark, sf_dir):
    return R.normalize_writes(merged(spark, sf_dir)).edges.select(*EDGE_COLS)


def _reach(spark, sf_dir, down: bool, depth: int) -> tuple[Graph, DataFrame, DataFrame]:
    g = merged(spark, sf_dir)
    seeds = g.nodes.filter("node_type = 'ADF_PIPELINE'" if down else "node_type = 'VIEW' AND metadata['source'] = 'llm'").select("id")
    steps = T.adjacency(g.edges, down)
    return g, steps, T.reach(steps, seeds, depth)


def upstream_depth(spark, sf_dir):
    return _reach(spark, sf_dir, False, 3)[2]


def downstream_depth(spark, sf_dir):
    return _reach(spark, sf_dir, True, 10)[2]


def bfs_edges(spark, sf_dir):
    _, steps, seen = _reach(spark, sf_dir, False, 2)
    return T.crossed(steps, seen, 2).select("source_id", "target_id", "edge_type")


def impact_summary(spark, sf_dir):
    out = T.impact(merged(spark, sf_dir), START)
    return out.select("source", F.array_join("affected_tables", ",").alias("affected_tables"), F.array_join("affected_columns", ",").alias("affected_columns"), F.col("total_affected").cast("long").alias("total_affected"))


def impact_ids(spark, sf_dir):
    found = T.downstream(merged(spark, sf_dir), START, T.MOST_DEPTH).nodes
    return found.filter(F.col("id") != START).select("id", "node_type")


def search_nodes(spark, sf_dir):
    g = merged(spark, sf_dir)
    return T.search(g.nodes, "Er#00000")


def summary_by_type(spark, sf_dir):
    return T.counts(merged(spark, sf_dir))


def edge_listing(spark, sf_dir):
    return T.listing(merged(spark, sf_dir), "DERIVES_FROM", 0.9).drop("transformation")


def diff_nodes(spark, sf_dir):
    a, b = snapshots(spark, sf_dir)
    return D.diff_nodes(a.nodes, b.nodes)


def diff_edges(spark, sf_dir):
    a, b = snapshots(spark, sf_dir)
    return D.diff_edges(a.edges, b.edges)


def diff_counts(spark, sf_dir):
    a, b = snapshots(spark, sf_dir)
    return D.diff_counts(D.diff_nodes(a.nodes, b.nodes), D.diff_edges(a.edges, b.edges))


def impacted_nodes(spark, sf_dir):
    a, b = snapshots(spark, sf_dir)
    return D.impacted(D.diff_nodes(a.nodes, b.nodes), D.diff_edges(a.edges, b.edges), a, b)


def report_rows(spark, sf_dir):
    a, b = snapshots(spark, sf_dir)
    return first_rows(D.diff_edges(a.edges, b.edges), MOST_EDGES, "source_id", "target_id", "edge_type").select("change_type", "source_id", "target_id", "edge_type")


def copy_source_columns(spark, sf_dir):
    return R.copy_source_rows(copies(spark, sf_dir)).select("dataset", "minted", "col")


def copy_sink_columns(spark, sf_dir):
    return R.copy_sink_rows(copies(spark, sf_dir)).select("sink", "minted", "col")


def notebook_remap(spark, sf_dir):
    rows = said(spark, sf_dir, "SELECT lang, source FROM documents")
    parsed = rows.select(F.concat_ws("/", "lang", F.concat("source", F.lit(".py"))).alias("id"), F.lit("").alias("origin"))
    book = rows.select(F.concat(F.lit("nb\\"), F.upper("source"), F.lit(".py")).alias("id"), F.lit("adf-notebook").alias("origin"))
    nodes = with_meta(parsed.union(book).distinct(), ["id"]).withColumn("node_type", F.lit("FILE"))
    return R.notebook_targets(nodes)


def classify_files(spark, sf_dir):
    f = said(spark, sf_dir, FILES_SQL)
    p = F.col("rel_path")
    return f.select("doc_id", "rel_path", S.kind(p).alias("kind"), S.folder(p).alias("folder"), basename(p).alias("base"))


def content_hash_cache(spark, sf_dir):
    f = said(spark, sf_dir, FILES_SQL).select("source_repo", F.regexp_extract("rel_path", "([^.]*)$", 1).alias("rel_path"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), "doc_id")
    kept = f.filter("source_repo <> 'src0'").select("source_repo", "rel_path", "sha256").unionByName(f.filter("rel_path = 'json'").select("source_repo", "rel_path", "sha256"))
    return S.cache_misses(f, kept).select("doc_id", "source_repo", "rel_path", "sha256")


def fallback_gate(spark, sf_dir):
    rows = said(spark, sf_dir, PROC_SQL).withColumn("content", F.when(F.col("lang") == "en", F.regexp_replace("content", "CREATE OR REPLACE procedure", "x")).when(F.col("lang") == "fr", F.concat(F.lit("select "), F.col("source"))).otherwise(F.col("content")))
    return rows.select("doc_id", S.needs_fallback(F.col("content"), F.col("lang") == "es").alias("needed"))


def link_procedures(spark, sf_dir):
    """What linking adds to the emissions of files that each create a routine and write to one table."""
    rows = said(spark, sf_dir, PROC_SQL).withColumn("path", F.col("doc_id").cast("string"))
    seq = F.struct(F.lit(0).alias("repo_idx"), "path", F.lit(0).cast("long").alias("emit_idx")).alias("seq")
    none = F.create_map().cast("map<string,string>").alias("metadata")
    nodes = rows.select(F.col("tbl").alias("id"), F.col("tbl").alias("name"), F.lit("TABLE").alias("node_type"), F.lit("").alias("source_repo"), none, seq)
    edges = rows.select(F.lit("somewhere").alias("source_id"), F.col("tbl").alias("target_id"), F.lit("WRITES_TO").alias("edge_type"), F.lit("").alias("transformation"), F.lit(1.0).alias("confidence"), none, seq)
    files = rows.select(F.lit(0).alias("repo_idx"), "path", "content")
    return R.link_procedures(files, Graph(nodes, edges)).edges.select(*EDGE_COLS)


def changed_files(spark, sf_dir):
    """Files of two snapshots: one kind is edited, one is gone."""
    f = said(spark, sf_dir, FILES_SQL).select("rel_path", "source_repo", F.endswith("rel_path", F.lit(".SQL")).alias("edited"), "content")
    head = f.filter("source_repo <> 'src3'").withColumn("content", F.when(F.col("edited"), F.concat("content", F.lit(" --"))).otherwise(F.col("content")))
    hashed = lambda d: d.select("rel_path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    return S.changed_files(hashed(f), hashed(head))


def relevant_files(spark, sf_dir):
    return S.relevant(said(spark, sf_dir, FILES_SQL).select(F.regexp_replace("rel_path", "^src1/", r"src1\\").alias("rel_path")), ["./src1", "src2/", "src30"])


def procedure_names(spark, sf_dir):
    return R.procedure_names(said(spark, sf_dir, PROC_SQL)).select("proc", F.col("tbl").alias("target"))


def insert_columns(spark, sf_dir):
    return R.insert_columns(said(spark, sf_dir, PROC_SQL)).select("doc_id", F.concat_ws(".", "tbl", "col").alias("col"))


FLOW_SQL = """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'df.to_sql' WHEN event_type = 'click' THEN 'INSERT into' WHEN event_type = 'view' THEN 'pd.read_sql' ELSE event_type END AS op,
  'u' || CAST(user_id AS STRING) AS s, 'e' || CAST(event_id AS STRING) AS t FROM events"""


def flow_direction(spark, sf_dir):
    rows = said(spark, sf_dir, FLOW_SQL)
    w = interpreter.writes(F.col("op"))
    return rows.select("event_id", F.when(w, F.col("s")).otherwise(F.col("t")).alias("source_id"), F.when(w, F.col("t")).otherwise(F.col("s")).alias("target_id"), F.when(w, "WRITES_TO").otherwise("READS_FROM").alias("edge_type"))


#: Source files made from rows: (rel_path, content), and for the third a response.
SQL_FILES = """SELECT 'sql/c' || CAST(c_custkey AS STRING) || '.sql' AS rel_path, 'CREATE TABLE dw.Raw_' || CAST(c_custkey AS STRING) || ' (id INT, "Amount" DECIMAL(18, 2), PRIMARY KEY (id)); -- note
  CREATE VIEW ' || lower(c_mktsegment) || '_' || CAST(c_custkey AS STRING) || ' AS SELECT r.id, r.amount  *  2 AS twice, COUNT(*) AS n FROM raw_' || CAST(c_custkey AS STRING) || ' r JOIN nation_' || CAST(c_nationkey AS STRING) || ' AS x ON x.id = r.id' AS content FROM customer"""
FACTORY_FILES = """SELECT 'adf/pipeline/p' || CAST(s_suppkey AS STRING) || '.json' AS rel_path, '{"name": "P' || CAST(s_suppkey AS STRING) || '", "properties": {"activities": [{"name": "cp", "type": "Copy", "inputs": [{"referenceName": "In'
  || CAST(s_suppkey AS STRING) || '"}], "outputs": [{"referenceName": "Out' || CAST(s_nationkey AS STRING) || '"}]}, {"name": "sp", "type": "SqlServerStoredProcedure", "typeProperties": {"storedProcedureName": "dbo.Refresh' || CAST(s_suppkey AS STRING) || '"}}]}}' AS content FROM supplier"""
CODE_FILES = """SELECT 'py/p' || CAST(p_partkey AS STRING) || '.py' AS rel_path, p_name AS content, '{"tables": [{"name": "T' || CAST(p_partkey AS STRING) || '", "type": "TABLE"}], "columns": [{"target_table": "t' || CAST(p_partkey AS STRING)
  || '", "target_column": "A", "source_table": "' || p_brand || '", "source_column": "b", "transformation": "sum"}], "data_flows": [{"source": "' || p_brand || '", "target": "t' || CAST(p_partkey AS STRING) || '", "operation": "df.to_sql"}]}' AS response FROM part"""


def made_files(spark, sf_dir, sql: str) -> DataFrame:
    return S.classified(said(spark, sf_dir, sql).select(F.lit(0).alias("repo_idx"), F.lit("r").alias("source_repo"), "rel_path", "content"))


def sql_column_lineage(spark, sf_dir):
    return sqltext.extract(made_files(spark, sf_dir, SQL_FILES)).edges.select(*EDGE_COLS)


def factory_lineage(spark, sf_dir):
    return factory.extract(made_files(spark, sf_dir, FACTORY_FILES)).edges.select(*EDGE_COLS)


def interpreted_lineage(spark, sf_dir):
    found = said(spark, sf_dir, CODE_FILES)
    told = found.select(F.lit("r").alias("source_repo"), "rel_path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), "response")
    return interpreter.extract(made_files(spark, sf_dir, CODE_FILES), told).edges.select(*EDGE_COLS)


#: The sample workload's kinds of statement, on the test tables; plain SQL that both engines run.
WORKLOAD = {
    "exposure_cumulative": """SELECT o.o_custkey, o.o_orderkey, CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS day, c.c_name || ' (' || n.n_name || ')' AS label,
      CAST(sum(CAST(o.o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS DOUBLE) AS exposure
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "daily_net": """SELECT l_suppkey, CAST(CAST(l_shipdate AS DATE) AS STRING) AS day, count(*) AS n,
      CAST(sum(CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(18, 2)) ELSE CAST(l_extendedprice AS DECIMAL(18, 2)) END) AS DOUBLE) AS net FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "risk_level": """SELECT o.o_orderkey, CASE WHEN c.c_custkey IS NULL THEN 'UNKNOWN' WHEN o.o_totalprice > 200000 AND c.c_acctbal < 0 THEN 'HIGH' WHEN o.o_totalprice > 100000 OR c.c_acctbal < 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk
      FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_mktsegment <> 'BUILDING'""",
    "regional_rollup": """SELECT r.r_name, n.n_name, count(DISTINCT c.c_custkey) AS customers, CAST(sum(CAST(c.c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS balance, max(c.c_acctbal) AS most,
      sum(CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END) AS overdrawn FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY r.r_name, n.n_name""",
    "customer_scores": """SELECT c.c_custkey, coalesce(a.n, 0) AS n, coalesce(a.avg_cents, 0) AS avg_cents, round(greatest(0, least(100, coalesce(a.dev, 0) / 1000)), 2) AS score,
      CASE WHEN coalesce(a.n, 0) > 15 THEN 'A' WHEN coalesce(a.n, 0) > 8 THEN 'B' ELSE 'C' END AS bucket FROM customer c LEFT JOIN
      (SELECT o_custkey, count(*) AS n, CAST(floor(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS avg_cents, stddev_samp(o_totalprice) AS dev FROM orders GROUP BY o_custkey) a ON a.o_custkey = c.c_custkey""",
    "monthly_summary": """SELECT CAST(make_date(year(o_orderdate), month(o_orderdate), 1) AS STRING) AS month, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
      FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN make_date(1995, 3, 1) AND make_date(1995, 3, 1) + INTERVAL '2' YEAR GROUP BY 1, 2""",
    "emission_counts": f"SELECT edge_type, count(*) AS n, count(DISTINCT source_id) AS sources, count(DISTINCT target_id) AS targets FROM ({EDGES_SQL}) GROUP BY edge_type",
    "node_emissions": f"SELECT node_type, origin, count(*) AS n, count(DISTINCT id) AS ids FROM ({NODES_SQL}) GROUP BY node_type, origin",
}


def workload(sql: str):
    return lambda spark, sf_dir: said(spark, sf_dir, sql)


def queries() -> dict:
    own = (classify_files, content_hash_cache, fallback_gate, merge_nodes, merge_edges, prune_round1, prune_fixpoint, normalize_writes, notebook_remap, copy_source_columns, copy_sink_columns, changed_files, relevant_files, procedure_names, link_procedures, insert_columns, flow_direction, sql_column_lineage, factory_lineage, interpreted_lineage, upstream_depth, downstream_depth, bfs_edges, impact_summary, impact_ids, search_nodes, summary_by_type, edge_listing, diff_nodes, diff_edges, diff_counts, impacted_nodes, report_rows)
    return {f.__name__: f for f in own} | {k: workload(v) for k, v in WORKLOAD.items()}


SNAPSHOTS = f"""{N_CTE}, {E_CTE},
  bn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN origin = 'llm' THEN 1 ELSE 0 END, rank, name) AS k FROM n WHERE name <> 'NF') WHERE k = 1),
  an AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN origin = 'llm' THEN 1 ELSE 0 END, rank, name) AS k FROM n WHERE name <> 'AF') WHERE k = 1),
  be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, edge_type ORDER BY confidence DESC, transformation) AS k FROM e WHERE confidence > 0.85) WHERE k = 1),
  ae AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, edge_type ORDER BY confidence DESC, transformation) AS k FROM e WHERE transformation <> 'A(F)') WHERE k = 1),
  dn AS (SELECT CASE WHEN bn.id IS NULL THEN 'ADDED' ELSE 'REMOVED' END AS change_type, coalesce(an.id, bn.id) AS id, coalesce(an.name, bn.name) AS name, coalesce(an.node_type, bn.node_type) AS node_type
    FROM bn FULL OUTER JOIN an ON an.id = bn.id WHERE bn.id IS NULL OR an.id IS NULL),
  de AS (SELECT CASE WHEN be.source_id IS NULL THEN 'ADDED' WHEN ae.source_id IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change_type, coalesce(ae.source_id, be.source_id) AS source_id,
    coalesce(ae.target_id, be.target_id) AS target_id, coalesce(ae.edge_type, be.edge_type) AS edge_type, coalesce(ae.transformation, be.transformation) AS transformation, coalesce(ae.confidence, be.confidence) AS confidence,
    CASE WHEN ae.source_id IS NOT NULL THEN be.transformation END AS previous_transformation, CASE WHEN ae.source_id IS NOT NULL THEN be.confidence END AS previous_confidence
    FROM be FULL OUTER JOIN ae ON ae.source_id = be.source_id AND ae.target_id = be.target_id AND ae.edge_type = be.edge_type
    WHERE be.source_id IS NULL OR ae.source_id IS NULL OR be.transformation <> ae.transformation OR be.confidence <> ae.confidence)"""


def impacted_sql() -> str:
    def side(name: str, edges: str, change: str) -> str:
        return f"""{name}h AS (SELECT CASE WHEN edge_type IN ('DERIVES_FROM', 'READS_FROM') THEN target_id ELSE source_id END AS src,
          CASE WHEN edge_type IN ('DERIVES_FROM', 'READS_FROM') THEN source_id ELSE target_id END AS dst FROM {edges} WHERE edge_type IN ('DERIVES_FROM', 'READS_FROM', 'WRITES_TO', 'COPIES_TO')
          UNION SELECT source_id, target_id FROM {edges} WHERE edge_type = 'READS_FROM' AND transformation LIKE '%ADF dataset%'),
        {name}r(id) AS (SELECT id FROM seeds WHERE change_type {change} UNION SELECT dst FROM {name}r JOIN {name}h ON src = id)"""

    return f"""WITH RECURSIVE {SNAPSHOTS},
    seeds AS (SELECT change_type, id FROM dn UNION SELECT change_type, CASE WHEN edge_type IN ('WRITES_TO', 'COPIES_TO') THEN target_id ELSE source_id END FROM de WHERE edge_type NOT IN ('HAS_COLUMN', 'DEFINED_IN')),
    {side("b", "be", "= 'REMOVED'")}, {side("a", "ae", "<> 'REMOVED'")}
    SELECT id FROM (SELECT id FROM br UNION SELECT id FROM ar) WHERE id NOT IN (SELECT id FROM seeds)"""


ALIAS_SQL = f"""WITH ce AS ({COPY_EDGES_SQL}), cn AS ({COPY_NODES_SQL}),
  al AS (SELECT source_id AS dataset, max(target_id) AS tbl FROM ce WHERE edge_type = 'READS_FROM' AND transformation LIKE '%ADF dataset%' GROUP BY 1),
  hc AS (SELECT source_id AS owner, target_id AS col FROM ce WHERE edge_type = 'HAS_COLUMN'), cp AS (SELECT source_id AS a, target_id AS b FROM ce WHERE edge_type = 'COPIES_TO')"""
GATE = " OR ".join(f"regexp_matches(content, '{p}', 'i')" for p in S.FALLBACK_PATTERNS)


def oracle_sql() -> dict[str, str]:
    within = {False: "SELECT id FROM mn WHERE node_type = 'VIEW' AND origin = 'llm'", True: "SELECT id FROM mn WHERE node_type = 'ADF_PIPELINE'"}
    start = reach_sql(True, f"SELECT '{START}' AS id", T.MOST_DEPTH).replace(f"r.depth < {T.MOST_DEPTH}", "TRUE").replace("r.depth + 1", "0")
    hit = f"{start}, x AS (SELECT mn.id, mn.node_type FROM s JOIN mn ON mn.id = s.id WHERE mn.id <> '{START}')"
    join = lambda kind: f"coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM x WHERE node_type IN {kind}), '')"
    return {
        "merge_nodes": f"WITH {N_CTE}, {MERGED_NODES} SELECT * FROM mn",
        "merge_edges": f"WITH {E_CTE}, {MERGED_EDGES} SELECT * FROM me",
        "prune_round1": f"{PRUNED} SELECT id FROM d1",
        "prune_fixpoint": f"{PRUNED} SELECT * FROM n6",
        "normalize_writes": f"""WITH {BOTH}, tl AS (SELECT id FROM mn WHERE node_type IN ('TABLE', 'VIEW')),
          w AS (SELECT * FROM me WHERE edge_type = 'WRITES_TO' AND source_id IN (SELECT id FROM tl) AND target_id IN (SELECT id FROM tl)),
          rd AS (SELECT source_id, target_id FROM me WHERE edge_type = 'READS_FROM')
          SELECT * FROM me WHERE NOT (edge_type = 'WRITES_TO' AND source_id IN (SELECT id FROM tl) AND target_id IN (SELECT id FROM tl))
          UNION ALL SELECT w.target_id, w.source_id, 'READS_FROM', w.transformation, w.confidence FROM w WHERE NOT EXISTS (SELECT 1 FROM rd WHERE rd.source_id = w.target_id AND rd.target_id = w.source_id)""",
        "upstream_depth": f"{reach_sql(False, within[False], 3)} SELECT id, depth FROM s",
        "downstream_depth": f"{reach_sql(True, within[True], 10)} SELECT id, depth FROM s",
        "bfs_edges": f"{reach_sql(False, within[False], 2)} SELECT DISTINCT source_id, target_id, edge_type FROM h JOIN s ON s.id = h.src WHERE s.depth < 2",
        "impact_ids": f"{hit} SELECT id, node_type FROM x",
        "impact_summary": f"""{hit} SELECT '{START}' AS source, {join("('TABLE', 'VIEW')")} AS affected_tables, {join("('COLUMN')")} AS affected_columns,
          (SELECT count(*) FROM x WHERE node_type IN ('TABLE', 'VIEW', 'COLUMN')) AS total_affected""",
        "search_nodes": f"""WITH {N_CTE}, {MERGED_NODES}, p AS (SELECT id, min(struct_pack(rank := rank, name := name)) AS place FROM n GROUP BY id)
          SELECT id, name, node_type FROM mn JOIN p USING (id) WHERE contains(lower(id), 'er#00000') OR contains(lower(name), 'er#00000') ORDER BY place, id LIMIT 50""",
        "summary_by_type": f"""WITH {BOTH} SELECT 'node_type' AS kind, node_type AS value, count(*) AS n FROM mn GROUP BY node_type
          UNION ALL SELECT 'edge_type', edge_type, count(*) FROM me GROUP BY edge_type
          UNION ALL SELECT 'certainty', CASE WHEN confidence < 1.0 THEN 'interpreted' ELSE 'deterministic' END, count(*) FROM me GROUP BY 2""",
        "edge_listing": f"""WITH {BOTH} SELECT '[LLM]' AS mark, edge_type, source_id, coalesce(a.node_type, '?') AS source_type, target_id, coalesce(b.node_type, '?') AS target_type, confidence
          FROM me LEFT JOIN mn a ON a.id = source_id LEFT JOIN mn b ON b.id = target_id WHERE edge_type = 'DERIVES_FROM' AND confidence < 0.9""",
        "diff_nodes": f"WITH {SNAPSHOTS} SELECT * FROM dn",
        "diff_edges": f"WITH {SNAPSHOTS} SELECT * FROM de",
        "diff_counts": f"""WITH {SNAPSHOTS} SELECT (SELECT count(*) FROM dn WHERE change_type = 'ADDED') AS nodes_added, (SELECT count(*) FROM dn WHERE change_type = 'REMOVED') AS nodes_removed,
          (SELECT count(*) FROM de WHERE change_type = 'ADDED') AS edges_added, (SELECT count(*) FROM de WHERE change_type = 'REMOVED') AS edges_removed, (SELECT count(*) FROM de WHERE change_type = 'MODIFIED') AS edges_modified""",
        "report_rows": f"WITH {SNAPSHOTS} SELECT change_type, source_id, target_id, edge_type FROM de ORDER BY source_id, target_id, edge_type LIMIT {MOST_EDGES}",
        "impacted_nodes": impacted_sql(),
        "copy_source_columns": f"""{ALIAS_SQL}, bare AS (SELECT id FROM cn WHERE node_type = 'ADF_DATASET' AND id NOT IN (SELECT owner FROM hc) AND id NOT IN (SELECT dataset FROM al)),
          th AS (SELECT a, b, CASE WHEN b IN (SELECT owner FROM hc) THEN b ELSE al.tbl END AS owner FROM cp JOIN bare ON bare.id = a LEFT JOIN al ON al.dataset = b)
          SELECT dataset, minted, col FROM (SELECT a AS dataset, a || '.' || split_part(col, '.', -1) AS minted, col, row_number() OVER (PARTITION BY a, a || '.' || split_part(col, '.', -1) ORDER BY a, b, th.owner, col) AS k
          FROM th JOIN hc ON hc.owner = th.owner) WHERE k = 1""",
        "copy_sink_columns": f"""{ALIAS_SQL} SELECT s.tbl AS sink, s.tbl || '.' || split_part(col, '.', -1) AS minted, col FROM cp JOIN al o ON o.dataset = a JOIN al s ON s.dataset = b JOIN hc ON hc.owner = o.tbl WHERE s.tbl NOT IN (SELECT owner FROM hc)""",
        "notebook_remap": "SELECT 'nb\\' || upper(source) || '.py' AS id, min(lang || '/' || source || '.py') AS kept FROM documents GROUP BY source",
        "classify_files": f"""WITH f AS ({FILES_SQL}), g AS (SELECT *, lower(rel_path) AS low, list_filter(string_split(lower(rel_path), '/'), lambda p: p IN ('pipeline', 'dataset', 'dataflow', 'trigger')) AS known FROM f)
          SELECT doc_id, rel_path, CASE WHEN regexp_matches(low, '\\.(sql|ddl|dml|hql)$') THEN 'sql' WHEN regexp_matches(low, '\\.(py|pyspark)$') THEN 'python' WHEN regexp_matches(low, '\\.json$') AND len(known) > 0 THEN 'factory' END AS kind,
          known[-1] AS folder, string_split(low, '/')[-1] AS base FROM g""",
        "content_hash_cache": f"""WITH f AS (SELECT doc_id, source_repo, string_split(rel_path, '.')[-1] AS rel_path, sha256(content) AS sha256 FROM ({FILES_SQL})),
          k AS (SELECT source_repo, rel_path, sha256 FROM f WHERE source_repo <> 'src0' OR rel_path = 'json')
          SELECT doc_id, source_repo, rel_path, sha256 FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.source_repo = f.source_repo AND k.rel_path = f.rel_path AND k.sha256 = f.sha256)""",
        "fallback_gate": f"""WITH p AS ({PROC_SQL}), q AS (SELECT doc_id, lang, CASE WHEN lang = 'en' THEN replace(content, 'CREATE OR REPLACE procedure', 'x') WHEN lang = 'fr' THEN 'select ' || source ELSE content END AS content FROM p)
          SELECT doc_id, ({GATE}) OR (lang <> 'es' AND length(trim(content)) > 100) AS needed FROM q""",
        "procedure_names": f"""WITH p AS ({PROC_SQL}) SELECT 'p' || CAST(doc_id AS STRING) AS proc, tbl AS target FROM p""",
        "link_procedures": f"""WITH p AS ({PROC_SQL}) SELECT 'p' || CAST(doc_id AS STRING) AS source_id, tbl AS target_id, 'WRITES_TO' AS edge_type, 'stored procedure output' AS transformation, CAST(1.0 AS DOUBLE) AS confidence FROM p
          UNION ALL SELECT tbl, tbl || '.' || unnest(['doc_id', 'lang', 'n_chars']), 'HAS_COLUMN', '', CAST(1.0 AS DOUBLE) FROM p""",
        "changed_files": f"SELECT rel_path FROM ({FILES_SQL}) WHERE source_repo = 'src3' OR suffix(rel_path, '.SQL')",
        "relevant_files": f"""SELECT replace(rel_path, 'src1/', 'src1\\') AS rel_path FROM ({FILES_SQL}) WHERE (prefix(rel_path, 'src1/') OR prefix(rel_path, 'src2/')) AND (regexp_matches(lower(rel_path), '\\.(sql|ddl|dml|hql|py|pyspark)$')
          OR (suffix(lower(rel_path), '.json') AND regexp_matches(lower(rel_path), '/(pipeline|dataset|dataflow|trigger)/')))""",
        "insert_columns": f"""WITH p AS ({PROC_SQL}) SELECT doc_id, tbl || '.' || unnest(['doc_id', 'lang', 'n_chars']) AS col FROM p""",
        "sql_column_lineage": """WITH c AS (SELECT 'raw_' || CAST(c_custkey AS STRING) AS t, lower(c_mktsegment) || '_' || CAST(c_custkey AS STRING) AS v, 'nation_' || CAST(c_nationkey AS STRING) AS x, 'r/sql/c' || CAST(c_custkey AS STRING) || '.sql' AS f FROM customer)
          SELECT a[1] AS source_id, a[2] AS target_id, a[3] AS edge_type, a[4] AS transformation, CAST(1.0 AS DOUBLE) AS confidence FROM (SELECT unnest([[t, f, 'DEFINED_IN', ''], [t, t || '.id', 'HAS_COLUMN', ''], [t, t || '.amount', 'HAS_COLUMN', ''],
          [v, f, 'DEFINED_IN', ''], [v, t, 'READS_FROM', ''], [v, x, 'READS_FROM', ''], [v, v || '.id', 'HAS_COLUMN', ''], [v || '.id', t || '.id', 'DERIVES_FROM', ''], [v, v || '.twice', 'HAS_COLUMN', ''], [v || '.twice', t || '.amount', 'DERIVES_FROM', 'r.amount * 2']]) AS a FROM c)""",
        "factory_lineage": """WITH s AS (SELECT 'adf.pipeline.P' || CAST(s_suppkey AS STRING) AS p, 'adf.dataset.In' || CAST(s_suppkey AS STRING) AS i, 'adf.dataset.Out' || CAST(s_nationkey AS STRING) AS o, 'refresh' || CAST(s_suppkey AS STRING) AS r, 'r/adf/pipeline/p' || CAST(s_suppkey AS STRING) || '.json' AS f FROM supplier)
          SELECT a[1] AS source_id, a[2] AS target_id, a[3] AS edge_type, a[4] AS transformation, CAST(1.0 AS DOUBLE) AS confidence FROM (SELECT unnest([[p, f, 'DEFINED_IN', ''], [p, i, 'READS_FROM', ''], [p, o, 'WRITES_TO', ''], [i, o, 'COPIES_TO', 'Copy(cp)'], [p, r, 'TRIGGERS', 'StoredProcedure(sp)']]) AS a FROM s)""",
        "interpreted_lineage": """WITH p AS (SELECT 't' || CAST(p_partkey AS STRING) AS t, lower(p_brand) AS b, 'r/py/p' || CAST(p_partkey AS STRING) || '.py' AS f FROM part)
          SELECT a[1] AS source_id, a[2] AS target_id, a[3] AS edge_type, a[4] AS transformation, CAST(CASE WHEN a[3] IN ('DERIVES_FROM', 'WRITES_TO') THEN 0.85 ELSE 1.0 END AS DOUBLE) AS confidence
          FROM (SELECT unnest([[t, f, 'DEFINED_IN', ''], [t, t || '.a', 'HAS_COLUMN', ''], [b, b || '.b', 'HAS_COLUMN', ''], [t || '.a', b || '.b', 'DERIVES_FROM', 'sum'], [b, t, 'WRITES_TO', 'df.to_sql']]) AS a FROM p)""",
        "flow_direction": f"""WITH f AS ({FLOW_SQL}), g AS (SELECT *, regexp_matches(lower(op), 'to_sql|insert|saveastable|write|savemode|df\\.to_') AS w FROM f)
          SELECT event_id, CASE WHEN w THEN s ELSE t END AS source_id, CASE WHEN w THEN t ELSE s END AS target_id, CASE WHEN w THEN 'WRITES_TO' ELSE 'READS_FROM' END AS edge_type FROM g""",
    } | WORKLOAD
