"""The tenant's scope on adversarial queries, and unbounded descent."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import guard
from quarry.operators import graph

P = lambda *names: " AND ".join(f"{n}.company_id = $company_id" for n in names)


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("MATCH (n) WHERE n.x = 1 OR n.y = 2 RETURN n", f"MATCH (n) WHERE ( n.x = 1 OR n.y = 2) AND {P('n')} RETURN n"),
        ("MATCH (a:X), (b:Y) RETURN a, b", f"MATCH (a:X), (b:Y) WHERE {P('a', 'b')} RETURN a, b"),
        ("MATCH p=(n)-->(m) RETURN p", f"MATCH p=(n)-->(m) WHERE {P('n', 'm')} RETURN p"),
        ("MATCH (:X)-[:r]->() RETURN 1", f"MATCH (n_0:X)-[:r]->(n_1) WHERE {P('n_0', 'n_1')} RETURN 1"),
        ("MATCH (n_0)-->({id: (1)}) RETURN 1", f"MATCH (n_0)-->(n_1{{id: (1)}}) WHERE {P('n_0', 'n_1')} RETURN 1"),
        ("MATCH (a)-[:r*1..3]->(b), q=(c)-[*]-(d) RETURN a", f"MATCH p_0 = (a)-[:r*1..3]->(b), q=(c)-[*]-(d) WHERE {P('a', 'b', 'c', 'd')} AND ALL(n_ IN nodes(p_0) WHERE n_.company_id = $company_id) AND ALL(n_ IN nodes(q) WHERE n_.company_id = $company_id) RETURN a"),
        ("MATCH p = shortestPath((a)-[*]-(b)) RETURN p", f"MATCH p = shortestPath((a)-[*]-(b)) WHERE {P('a', 'b')} AND ALL(n_ IN nodes(p) WHERE n_.company_id = $company_id) RETURN p"),
        ("MATCH (n) WHERE n.name STARTS WITH 'RETURN' OR n.x = \"WHERE (\" RETURN n", f"MATCH (n) WHERE ( n.name STARTS WITH 'RETURN' OR n.x = \"WHERE (\") AND {P('n')} RETURN n"),
        ("MATCH (n) // WHERE 1=1 RETURN\nRETURN n", f"MATCH (n) WHERE {P('n')} // WHERE 1=1 RETURN\nRETURN n"),
        ("MATCH (n) WHERE n.x = 1 // OR\nRETURN n;", f"MATCH (n) WHERE ( n.x = 1) AND {P('n')} // OR\nRETURN n;"),
        ("MATCH (`a b`:X) /* MATCH (z) */ WITH `a b` AS x MATCH (x)--(y) RETURN y ORDER BY y.z LIMIT 3", f"MATCH (`a b`:X) WHERE {P('`a b`')} /* MATCH (z) */ WITH `a b` AS x MATCH (x)--(y) WHERE {P('x', 'y')} RETURN y ORDER BY y.z LIMIT 3"),
        ("MATCH (n) RETURN n.match, n.with UNION MATCH (m) RETURN m.x, 1", f"MATCH (n) WHERE {P('n')} RETURN n.match, n.with UNION MATCH (m) WHERE {P('m')} RETURN m.x, 1"),
        ("MATCH (n WHERE n.x > (1+2) OR true) RETURN n", f"MATCH (n WHERE n.x > (1+2) OR true) WHERE {P('n')} RETURN n"),
        ("MATCH ((a)-[:r]->(b)){1,3} RETURN a", f"MATCH ((a)-[:r]->(b)){{1,3}} WHERE {P('a', 'b')} RETURN a"),
        ("MATCH (n) WHERE (n.a + 1) * (n.b) > 2 RETURN count(n)", f"MATCH (n) WHERE ( (n.a + 1) * (n.b) > 2) AND {P('n')} RETURN count(n)"),
    ],
)
def test_scoped(q, want):
    assert guard.with_tenant(q) == want


@pytest.mark.parametrize(
    "q",
    [
        "MATCH (n {Company_ID: 1}) RETURN n", "RETURN 1", "", "MATCH (n) WHERE (n)-->(m) RETURN n", "MATCH (n) RETURN [(n)-[:r]->(m) | m.x]", "MATCH (n) WHERE EXISTS { MATCH (m) } RETURN n", "MATCH (n) RETURN COUNT { (n)--(m) }",
        "MATCH (n RETURN n", "MATCH (n)) RETURN n", "MATCH (n) WHERE n.x = 'open RETURN n", "MATCH (n) /* open RETURN n", "MATCH (n) RETURN n; MATCH (m) RETURN m", "MATCH (n {x: [(m)--(k) | k.y]}) RETURN n", "MATCH (n) WHERE RETURN n", "MATCH RETURN 1", "MATCH (n) WHERE (n)<--(m) RETURN n",
    ],
)
def test_refused(q):
    with pytest.raises(guard.Refused):
        guard.with_tenant(q)


def test_scoped_column(spark):
    rows = spark.createDataFrame([(0, None), (1, "MATCH (n) RETURN n"), (2, "MATCH (n) RETURN n" + " " * 5000), (3, "RETURN 1")], "i int, q string").select("i", guard.scoped(F.col("q")).alias("s")).orderBy("i").collect()
    assert [r.s.q for r in rows] == [None, f"MATCH (n) WHERE {P('n')} RETURN n", None, None] and [r.s.error is None for r in rows] == [False, True, False, False]


def test_descent_with_cycles_and_depth(spark):
    chain = spark.range(60).selectExpr("id as src", "id + 1 as dst").unionByName(spark.createDataFrame([(60, 0), (5, 5), (3, 50), (None, 1), (1, None)], "src long, dst long"))
    got = {r.id: r.depth for r in graph.descendants(chain, spark.createDataFrame([(0,), (0,), (None,)], "id long")).collect()}
    assert got == {i: i if i < 50 else min(i, i - 50 + 4) for i in range(61)}
    assert graph.descendants(chain, spark.createDataFrame([], "id long")).collect() == []
