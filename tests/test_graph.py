"""Graph operators on small graphs, and a repository of our own end to end."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from headwater.functions.graph import EDGES, NODES, Graph
from headwater.operators import diff as D
from headwater.operators import merge as M
from headwater.operators import rewrite as R
from headwater.operators import traverse as T
from headwater.plans import build as B
from headwater.plans import review as V
from headwater.sources import factory, interpreter
from headwater.sources import files as S


def graph(spark, nodes, edges):
    """nodes: (id, type, origin); edges: (source, target, type, note, confidence)."""
    n = [(i, i, t, "", {"source": o} if o else {}, (0, ["f"], k)) for k, (i, t, o) in enumerate(nodes)]
    e = [(s, t, k, note, float(c), {}, (0, ["f"], i)) for i, (s, t, k, note, c) in enumerate((*x, *("", 1.0)[len(x) - 3 :]) for x in edges)]
    return Graph(spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES))


def ids(df, col="id"):
    return {r[col] for r in df.collect()}


def keys(df):
    return {(r.source_id, r.target_id, r.edge_type) for r in df.collect()}


def test_merge_prefers_parsed_nodes_and_confident_edges(spark):
    g = graph(spark, [("a", "TABLE", "llm"), ("a", "VIEW", ""), ("a", "TABLE", ""), ("b", "TABLE", "llm"), ("b", "VIEW", "llm")], [("a", "b", "READS_FROM", "x", 0.85), ("a", "b", "READS_FROM", "y", 1.0), ("a", "b", "READS_FROM", "z", 1.0)])
    m = M.merge(g)
    assert {(r.id, r.node_type) for r in m.nodes.collect()} == {("a", "VIEW"), ("b", "TABLE")}
    assert [(r.transformation, r.confidence) for r in m.edges.collect()] == [("y", 1.0)]
    again = M.merge(m)
    assert sorted(again.nodes.collect()) == sorted(m.nodes.collect())


def test_prune_runs_to_a_fixpoint(spark):
    g = graph(spark, [("f", "FILE", ""), ("p", "PROCEDURE", ""), ("lone", "TABLE", ""), ("bare", "TABLE", "llm"), ("fed", "VIEW", ""), ("kept", "TABLE", "llm"), ("kept.c", "COLUMN", "")], [("lone", "f", "DEFINED_IN"), ("fed", "bare", "READS_FROM"), ("kept", "kept.c", "HAS_COLUMN")])
    assert ids(R.dead_nodes(g.nodes, g.edges)) == {"lone", "bare"}
    out = R.prune(g)
    assert ids(out.nodes) == {"f", "p", "kept", "kept.c"} and keys(out.edges) == {("kept", "kept.c", "HAS_COLUMN")}
    assert ids(R.prune(out).nodes) == ids(out.nodes)


def test_writes_between_tables_turn_unless_read_already(spark):
    nodes = [("a", "TABLE", ""), ("b", "VIEW", ""), ("c", "TABLE", ""), ("p", "PROCEDURE", "")]
    out = R.normalize_writes(graph(spark, nodes, [("a", "b", "WRITES_TO", "n", 0.85), ("p", "a", "WRITES_TO"), ("a", "c", "WRITES_TO"), ("c", "a", "READS_FROM")]))
    assert keys(out.edges) == {("b", "a", "READS_FROM"), ("p", "a", "WRITES_TO"), ("c", "a", "READS_FROM")}
    same = R.normalize_writes(graph(spark, nodes, [("a", "c", "WRITES_TO"), ("c", "a", "READS_FROM")]))
    assert keys(same.edges) == {("a", "c", "WRITES_TO"), ("c", "a", "READS_FROM")}


def test_notebooks_join_the_parsed_file(spark):
    g = graph(spark, [("py/job.py", "FILE", ""), ("nb\\Job.py", "FILE", "adf-notebook"), ("pl", "ADF_PIPELINE", ""), ("t", "TABLE", "")], [("pl", "nb\\Job.py", "TRIGGERS"), ("nb\\Job.py", "t", "WRITES_TO"), ("py/job.py", "nb\\Job.py", "DEFINED_IN")])
    out = R.merge_notebooks(g)
    assert "nb\\Job.py" not in ids(out.nodes) and keys(out.edges) == {("pl", "py/job.py", "TRIGGERS"), ("py/job.py", "t", "WRITES_TO")}


COPY = [("d1", "ADF_DATASET", ""), ("d2", "ADF_DATASET", ""), ("d3", "ADF_DATASET", ""), ("t2", "TABLE", ""), ("t2.c", "COLUMN", ""), ("t3", "TABLE", "")]
COPY_EDGES = [("d1", "d2", "COPIES_TO"), ("d2", "t2", "READS_FROM", "ADF dataset → physical table", 1.0), ("t2", "t2.c", "HAS_COLUMN"), ("d2", "d3", "COPIES_TO"), ("d3", "t3", "READS_FROM", "ADF dataset → physical table", 1.0)]


def test_copies_give_both_ends_columns(spark):
    g = graph(spark, COPY, COPY_EDGES)
    src = R.infer_copy_sources(g)
    assert {("d1", "d1.c", "HAS_COLUMN"), ("t2.c", "d1.c", "DERIVES_FROM")} <= keys(src.edges) and "d1.c" in ids(src.nodes)
    out = R.infer_copy_sinks(src)
    assert {("t3", "t3.c", "HAS_COLUMN"), ("t3.c", "t2.c", "DERIVES_FROM")} <= keys(out.edges)
    assert {r.confidence for r in out.edges.filter("transformation like '1:1%'").collect()} == {0.9}


def test_walks_follow_data_flow_and_aliases(spark):
    g = graph(spark, [*COPY, ("v", "VIEW", ""), ("p", "PROCEDURE", ""), ("v.c", "COLUMN", "")], [*COPY_EDGES, ("v", "t2", "READS_FROM"), ("v", "ghost", "READS_FROM"), ("p", "t2", "WRITES_TO"), ("v", "v.c", "HAS_COLUMN"), ("v.c", "t2.c", "DERIVES_FROM")])
    up = T.upstream(g, "v")
    assert ids(up.nodes) == {"v", "t2", "d2", "d1", "p"} and ("v", "ghost", "READS_FROM") in keys(up.edges)
    assert ids(T.downstream(g, "d1").nodes) == {"d1", "d2", "t2", "d3", "t3", "v"}
    assert ids(T.upstream(g, "v", 1).nodes) == {"v", "t2"}
    one = T.impact(g, "p").first()
    assert one.affected_tables == ["t2", "t3", "v"] and one.affected_columns == [] and one.total_affected == 3
    with pytest.raises(KeyError):
        T.upstream(g, "nobody")
    with pytest.raises(ValueError):
        T.upstream(g, "v", 51)
    assert [r.id for r in T.search(g.nodes, "T2").collect()] == ["t2", "t2.c"]


def test_differences_and_what_they_reach(spark):
    nodes = [(x, "COLUMN", "") for x in ("a", "b", "c", "d")]
    before = graph(spark, nodes[:3], [("b", "a", "DERIVES_FROM", "x", 1.0), ("c", "b", "DERIVES_FROM")])
    after = graph(spark, nodes[:3], [("b", "a", "DERIVES_FROM", "y", 1.0), ("c", "b", "DERIVES_FROM")])
    n, e, counts, hit = V.compare(before, after)
    assert counts == {"nodes_added": 0, "nodes_removed": 0, "edges_added": 0, "edges_removed": 0, "edges_modified": 1} and ids(hit) == {"c"}
    same = V.compare(before, before)
    assert not any(same[2].values()) and not ids(same[3])
    gone = graph(spark, nodes[1:3], [("c", "b", "DERIVES_FROM")])
    n, e, counts, hit = V.compare(before, gone)
    assert counts["nodes_removed"] == 1 and counts["edges_removed"] == 1 and ids(hit) == {"c"}
    back = D.diff_nodes(gone.nodes, before.nodes)
    assert [r.change_type for r in back.collect()] == ["ADDED"]
    structural = graph(spark, nodes[:3], [("b", "a", "DERIVES_FROM", "x", 1.0), ("c", "b", "DERIVES_FROM"), ("a", "b", "HAS_COLUMN")])
    assert not ids(V.compare(before, structural)[3])


PIPELINE = {"name": "Load", "properties": {"activities": [
    {"name": "cp", "type": "Copy", "inputs": [{"referenceName": "In"}], "outputs": [{"referenceName": "Out"}]},
    {"name": "sub", "type": "ExecutePipeline", "typeProperties": {"pipeline": {"referenceName": "Next"}}},
    {"name": "nb", "type": "DatabricksNotebook", "typeProperties": {"notebookPath": "jobs\\\\score.py", "baseParameters": {"target_table": "dw.Scores"}}},
    {"name": "sp", "type": "SqlServerStoredProcedure", "typeProperties": {"storedProcedureName": "dbo.Refresh"}},
    {"name": "df", "type": "ExecuteDataFlow", "typeProperties": {"dataFlow": {"referenceName": "Shape"}}},
    {"name": "zz", "type": "Wait"}]}}


def files_of(spark, rows):
    return S.classified(spark.createDataFrame([(0, "r", p, c) for p, c in rows], "repo_idx int, source_repo string, rel_path string, content string"))


def test_factory_artefacts(spark):
    f = files_of(spark, [("pipeline/Load.json", json.dumps(PIPELINE)), ("dataset/In.json", '{"name": "In", "properties": {"typeProperties": {"schema": "x", "table": "Stage_In"}}}'), ("dataset/Out.json", '{"name":"Out","properties":{"typeProperties":{"location":{"fileName":"a.csv"}}}}'), ("dataflow/Shape.json", '{"properties": {"typeProperties": {"sources": [{"dataset": {"referenceName": "In"}}], "sinks": [{"dataset": {"referenceName": "Out"}}]}}}'), ("pipeline/bad.json", "{not json"), ("trigger/t.json", "{}"), ("other/x.json", "{}")])
    g = factory.extract(f)
    assert {("adf.pipeline.Load", "r/pipeline/Load.json", "DEFINED_IN"), ("adf.dataset.In", "adf.dataset.Out", "COPIES_TO"), ("adf.pipeline.Load", "adf.dataset.In", "READS_FROM"), ("adf.pipeline.Load", "adf.dataset.Out", "WRITES_TO"), ("adf.pipeline.Load", "adf.pipeline.Next", "TRIGGERS"), ("adf.pipeline.Load", "refresh", "TRIGGERS"), ("adf.pipeline.Load", "adf.dataflow.Shape", "TRIGGERS"), ("adf.dataset.In", "stage_in", "READS_FROM"), ("adf.dataflow.Shape", "adf.dataset.In", "READS_FROM"), ("adf.dataflow.Shape", "adf.dataset.Out", "WRITES_TO")} <= keys(g.edges)
    assert "scores" in ids(g.edges, "target_id") and len(keys(g.edges)) == 12
    assert {r.name for r in g.nodes.filter("id = 'stage_in'").collect()} == {"Stage_In"}


def test_interpreted_responses(spark):
    good = {"tables": [{"name": "Out", "type": "TABLE"}, {"name": "fn", "type": "PYTHON_FUNCTION"}, {"name": "g", "type": "PYTHON_FUNCTION"}], "columns": [{"target_table": "out", "target_column": "A", "source_table": "src", "source_column": "b", "transformation": "x"}, {"target_table": None, "target_column": "q", "source_table": "s", "source_column": "t"}], "data_flows": [{"source": "src", "target": "out", "operation": "df.to_sql"}, {"source": "src", "target": "mid", "operation": "pd.read_sql"}, {"source": "fn", "target": "g", "operation": "call"}]}
    f = files_of(spark, [("a.py", "1"), ("b.py", "2"), ("c.py", "3")])
    sha = {r.rel_path: r.sha256 for r in f.collect()}
    resp = spark.createDataFrame([("r", "a.py", sha["a.py"], "```json\n" + json.dumps(good) + "\n```"), ("r", "b.py", sha["b.py"], "no json"), ("r", "c.py", "stale", json.dumps(good))], B.RESPONSES)
    g = interpreter.extract(f, resp)
    assert ids(g.nodes.filter("node_type = 'FILE'")) == {"r/a.py"}
    assert {("src", "out", "WRITES_TO"), ("mid", "src", "READS_FROM"), ("out.a", "src.b", "DERIVES_FROM"), ("out", "out.a", "HAS_COLUMN"), ("src", "src.b", "HAS_COLUMN")} <= keys(g.edges)
    assert not {k for k in keys(g.edges) if k[0] == "fn" and k[1] == "g"} and {r.confidence for r in g.edges.filter("edge_type = 'WRITES_TO'").collect()} == {0.85}


def test_gate_relevance_and_classes(spark):
    texts = ["CREATE OR REPLACE PROCEDURE p AS x", "execute immediate 'x'", "SELECT 1", "CREATE VIEW v AS SELECT CASE WHEN a THEN 1 END", "x" * 101, "DECLARE x int; BEGIN"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(S.needs_fallback(F.col("t"), F.col("i") < 0)).collect()] == [True, True, False, False, True, True]
    paths = ["sql/a.sql", "./x.py", "adf/Pipeline/p.json", "adf/other/p.json", "sqlx/a.sql", "sql/readme.md"]
    p = spark.createDataFrame([(x,) for x in paths], "rel_path string")
    assert ids(S.relevant(p, ["./sql", "adf/"]), "rel_path") == {"sql/a.sql", "adf/Pipeline/p.json"}
    assert {r.rel_path: r.k for r in p.select("rel_path", S.kind(F.col("rel_path")).alias("k")).collect()}["./x.py"] == "python"


def test_a_repository_end_to_end_and_its_review(spark, tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)

    (tmp_path / "sql").mkdir()
    (tmp_path / "sql/a.sql").write_text("CREATE TABLE src (id INT, amount INT);")
    (tmp_path / "sql/b.sql").write_text("CREATE VIEW v AS SELECT src.id, src.amount FROM src;\nCREATE VIEW w AS SELECT v.amount AS m FROM v;")
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "sql/b.sql").write_text("CREATE VIEW v AS SELECT src.id, src.amount, src.amount * 2 AS twice FROM src;\nCREATE VIEW w AS SELECT v.amount AS m FROM v;")
    git("commit", "-qam", "two")
    repos = [B.Repository("sql", "sql"), B.Repository("none", "nowhere")]
    r = V.review(spark, str(tmp_path), repos, "HEAD~1")
    assert r.relevant == ["sql/b.sql"] and r.counts["nodes_added"] == 1 and r.counts["edges_added"] == 2
    text = V.report(r)
    assert "+ v.twice (column)" in text and text.endswith("\n") and json.dumps(r.as_dict(), default=str)
    assert len(r.as_dict(1)["edge_changes"]) == 1 and r.as_dict(1)["edge_changes_total"] == 2
    r.write(str(tmp_path / "review"))
    assert spark.read.json(str(tmp_path / "review/edges")).count() == 2
    nothing = V.review(spark, str(tmp_path), repos, "HEAD")
    assert "not built" in V.report(nothing)
    g = B.build(spark, [B.Repository("sql", str(tmp_path / "sql"))])
    B.write_json(g, str(tmp_path / "out"))
    assert B.read_json(spark, str(tmp_path / "out")).edges.count() == g.edges.count()
    assert {x.source_repo for x in g.nodes.collect()} == {"sql"}


def test_procedures_link_to_what_their_file_writes(spark):
    sql = 'CREATE PROCEDURE app.Fill() AS $$ INSERT INTO dw.out (a, "B") SELECT 1 $$'
    f = files_of(spark, [("p.sql", sql)])
    resp = spark.createDataFrame([("r", "p.sql", f.first().sha256, json.dumps({"tables": [{"name": "out", "type": "TABLE"}], "columns": [{"target_table": "out", "target_column": "a", "source_table": "s", "source_column": "x"}], "data_flows": [{"source": "s", "target": "out", "operation": "INSERT"}]}))], B.RESPONSES)
    g = B.emissions(f, resp)
    assert ("fill", "out", "WRITES_TO") in keys(g.edges) and ("out", "out.b", "HAS_COLUMN") in keys(g.edges)
    assert {r.metadata["source"] for r in g.nodes.filter("id = 'out.b'").collect()} == {"unmapped"}


def test_a_stream_of_files_appends_emissions(spark, tmp_path):
    from headwater.streaming.watch import watch_sql

    spec = "repo_idx int, source_repo string, rel_path string, content string"
    spark.createDataFrame([(0, "r", "a.sql", "CREATE VIEW v AS SELECT t.a FROM t")], spec).write.parquet(str(tmp_path / "in"))
    watch_sql(spark.readStream.schema(spec).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/edges")).count() == 4


def test_command_line(spark, tmp_path, capsys):
    from headwater.__main__ import main

    (tmp_path / "sql").mkdir()
    (tmp_path / "sql/a.sql").write_text("CREATE TABLE t (a INT);\nCREATE VIEW v AS SELECT t.a FROM t;")
    assert main(["analyze", "--repo", f"sql={tmp_path}/sql", "--out", str(tmp_path / "g")]) == 0
    assert main(["upstream", str(tmp_path / "g"), "v.a"]) == 0 and "t.a" in capsys.readouterr().out
    assert main(["impact", str(tmp_path / "g"), "nobody"]) == 1
    assert main(["summary", str(tmp_path / "g"), "--type", "DERIVES_FROM"]) == 0
    assert main(["search", str(tmp_path / "g"), "V"]) == 0


def test_scan_opens_known_files_only(spark, tmp_path):
    for name in ("a.SQL", "b.Py", "c.txt", "pipeline/d.json", "other/e.json", "x y+z.sql"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"SELECT \xff")
    found = {r.rel_path: (r.kind, r.content) for r in S.scan(spark, str(tmp_path), "r").collect()}
    assert set(found) == {"a.SQL", "b.Py", "pipeline/d.json", "x y+z.sql"} and found["a.SQL"] == ("sql", "SELECT \ufffd")
    assert "pipeline/d.json" not in {r.rel_path for r in S.scan(spark, str(tmp_path), "r", recursive=False).collect()}
