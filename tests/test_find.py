import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ashlar.operators import graph as g
from ashlar.plans import find as fd


@pytest.fixture(scope="module")
def own(spark):
    """Ten files of a hundred functions and ten classes."""
    nodes, edges = [], []
    for f in range(10):
        nodes.append((f"file:f{f}", "file", f"f{f}", None))
        for i in range(100):
            nodes.append((f"function:f{f}:func_{i}", "function", f"func_{i}", i % 20 + 1))
            edges.append((f"file:f{f}", f"function:f{f}:func_{i}", "contains"))
            if i < 99:
                edges.append((f"function:f{f}:func_{i}", f"function:f{f}:func_{i + 1}", "calls"))
        for i in range(10):
            nodes.append((f"class:f{f}:class_{i}", "class", f"class_{i}", None))
            edges.append((f"file:f{f}", f"class:f{f}:class_{i}", "contains"))
            if i < 9:
                edges.append((f"class:f{f}:class_{i}", f"class:f{f}:class_{i + 1}", "inherits"))
        if f < 9:
            edges.append((f"function:f{f}:func_50", f"function:f{f + 1}:func_0", "calls"))
    return g.Graph(spark.createDataFrame(nodes, "id string, type string, name string, complexity int").cache(), spark.createDataFrame(edges, "source string, target string, type string").cache())


@pytest.mark.parametrize("text, n", [
    ("FIND function", 1000), ("FIND functions", 1000), ("FIND function WHERE complexity > 10", 500), ("FIND function WHERE complexity > 5 AND complexity < 15", 450),
    ("FIND function WHERE complexity > 18 OR complexity < 3", 200), ("FIND function WHERE CALLING 'func_1'", 110), ("FIND function LIMIT 50", 50),
    ("FIND function LIMIT 0", 1000), ("FIND file WHERE complexity != 3", 0), ("FIND file WHERE CONTAINS 'class_3'", 10), ("find Class where inherits 'class_9' limit 3", 3),
    ("FIND function OFFSET 990 LIMIT 50", 10), ("FIND function WHERE name LIKE 'FUNC_9'", 110), ("FIND class WHERE NOT INHERITS '*'", 10),
])
def test_rows(own, text, n):
    assert fd.find(text, own.nodes, own.edges).count() == n


def test_total_count_ignores_paging(own):
    assert fd.total_count("FIND function LIMIT 50", own.nodes, own.edges).first()[0] == 1000


@pytest.mark.parametrize("text", ["FIND", "FIND function WHERE", "FIND function WHERE a -1", "FIND function LIMIT x", "FIND function extra", "SELECT *", "FIND function WHERE CALLING x", "FIND function WHERE f.name = 'x'", "FIND function LIMIT 1 LIMIT 2"])
def test_errors(text):
    with pytest.raises(fd.FindError):
        fd.parse(text)


def test_parse():
    query = fd.parse("FIND function AS f WHERE complexity >= 2.5 OR name <> 'x' AND CALLING 'y' LIMIT 3 OFFSET 4")
    assert (query.kind, query.alias, query.limit, query.offset) == ("function", "f", 3, 4)
    assert query.attributes == [fd.Attribute("complexity", ">=", 2.5), fd.Attribute("name", "!=", "x", "OR")]
    assert query.relations == [fd.Relation("calls", "y")]


def test_validation():
    assert fd.validate(fd.parse("FIND function WHERE shoe = 1")) == ["function has no attribute shoe"]
    with pytest.raises(fd.FindError):
        fd.validate(fd.parse("FIND spoon"))


def test_variant_properties(spark):
    nodes = spark.sql("""SELECT 'a' AS id, 'function' AS type, parse_json('{"depth": 7}') AS properties UNION ALL SELECT 'b', 'function', parse_json('{}')""")
    edges = spark.createDataFrame([], "source string, target string, type string")
    assert [r.id for r in fd.find("FIND function WHERE depth > 5", nodes, edges).collect()] == ["a"]


def test_relation_is_a_semi_join(own):
    plan = fd.find("FIND function WHERE CALLING 'func_1'", own.nodes, own.edges)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["AND", "OR"]), st.sampled_from(["=", "!=", "<", ">", "<=", ">="]), st.integers(0, 21)), min_size=1, max_size=4))
def test_fold_from_left_to_right(own, terms):
    text = "FIND function WHERE " + " ".join(f"{joined if i else ''} complexity {op} {n}" for i, (joined, op, n) in enumerate(terms))
    test = {"=": int.__eq__, "!=": int.__ne__, "<": int.__lt__, ">": int.__gt__, "<=": int.__le__, ">=": int.__ge__}

    def holds(c):
        value = test[terms[0][1]](c, terms[0][2])
        for joined, op, n in terms[1:]:
            value = value and test[op](c, n) if joined == "AND" else value or test[op](c, n)
        return value

    assert fd.find(text, own.nodes, own.edges).count() == sum(holds(i % 20 + 1) for i in range(100)) * 10


def test_traversal(own, spark):
    start = spark.createDataFrame([("file:f0",)], "id string")
    assert g.reach(own.edges, start, 1).count() == 111
    assert g.reach(own.edges, start, 5).count() == 115
    assert g.unused_functions(own.nodes, own.edges).count() == 1
    assert g.complex_functions(own.nodes, 15).count() == 250
    assert g.hierarchy(own.nodes, own.edges, "class_9", 1).count() == 20


def test_subgraph_depths(spark):
    nodes = spark.createDataFrame([(f"f{i}", "function") for i in range(3)], "id string, type string")
    edges = spark.createDataFrame([("f0", "f1", "calls"), ("f1", "f2", "calls")], "source string, target string, type string")
    for depth, n in ((2, 3), (1, 2)):
        found = g.subgraph(g.Graph(nodes, edges), "f0", depth)
        assert (found.nodes.count(), found.edges.count()) == (n, n - 1)


def test_json_round_trip(own):
    from ashlar.sources.writers import from_graph_json, graph_json

    back = from_graph_json(graph_json(own), "id string, type string, name string, complexity int", "source string, target string, type string")
    assert back.nodes.subtract(own.nodes).isEmpty() and own.edges.subtract(back.edges).isEmpty()
