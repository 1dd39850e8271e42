"""Properties: the SQL reader never fails, walks equal a recursive query, differences are symmetric."""

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from headwater.functions.graph import EDGES, NODES, Graph
from headwater.operators import diff as D
from headwater.operators import traverse as T
from headwater.sources.sqltext import lineage, statements

WORDS = st.sampled_from("create view v as select a . b , from t join u on ( ) case when then end ; insert into with 'x' \"Q\" -- \n $$ x over partition by :: int 1 union * distinct extract year".split(" "))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.lists(WORDS, max_size=40).map(" ".join)))
def test_any_text_is_read(text):
    nodes, edges = lineage(text)
    assert all(len(n) == 4 for n in nodes) and all(len(e) == 4 for e in edges)
    assert sum(map(len, statements(text))) >= 0


NAMES = "abcdefg"
EDGE = st.tuples(st.sampled_from(NAMES), st.sampled_from(NAMES), st.sampled_from(["DERIVES_FROM", "READS_FROM", "WRITES_TO", "COPIES_TO", "TRIGGERS", "HAS_COLUMN"]), st.sampled_from(["", "ADF dataset"]))


def graph(spark, edges):
    rows = [(*e, 1.0, {}, (0, ["f"], i)) for i, e in enumerate(dict.fromkeys(edges))]
    nodes = [(n, n, "TABLE", "", {}, (0, ["f"], i)) for i, n in enumerate(sorted({x for e in edges for x in e[:2]}))]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(rows, EDGES))


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(EDGE, min_size=3, max_size=14), st.booleans())
def test_walks_equal_a_recursive_query(spark, edges, down):
    pulls = ("DERIVES_FROM", "READS_FROM")
    hops = set()
    for s, t, k, note in edges:
        if k in (*pulls, "WRITES_TO", "COPIES_TO"):
            consumer, producer = (s, t) if k in pulls else (t, s)
            hops.add((producer, consumer) if down else (consumer, producer))
            if k == "READS_FROM" and note:
                hops.add((s, t) if down else (t, s))
    start = edges[0][0]
    con = duckdb.connect()
    con.execute("create table h (a varchar, b varchar)")
    con.executemany("insert into h values (?, ?)", [list(x) for x in hops] or [["-", "-"]])
    want = {r[0] for r in con.execute("with recursive r(id) as (select ? union select b from r join h on a = id) select id from r", [start]).fetchall()}
    got = T.reach(T.adjacency(graph(spark, edges).edges, down), spark.createDataFrame([(start,)], "id string"))
    assert {r.id for r in got.collect()} == want


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(EDGE, min_size=1, max_size=8), st.lists(EDGE, min_size=1, max_size=8))
def test_differences_are_symmetric(spark, one, two):
    a, b = graph(spark, one), graph(spark, two)
    swap = {"ADDED": "REMOVED", "REMOVED": "ADDED", "MODIFIED": "MODIFIED"}
    rows = lambda d: {(r.change_type, r.source_id, r.target_id, r.edge_type) for r in d.collect()}
    assert {(swap[r[0]], *r[1:]) for r in rows(D.diff_edges(a.edges, b.edges))} == rows(D.diff_edges(b.edges, a.edges))
    assert not rows(D.diff_edges(a.edges, a.edges)) and not D.diff_nodes(a.nodes, a.nodes).count()
