"""Arguments and answers of the tools on a graph of five nodes."""

import pytest

from tessera.api import TOOLS, Engine, validate


@pytest.fixture(scope="module")
def engine(spark):
    nodes = spark.createDataFrame([(1, "METHOD", "pay.charge", "a.py", 9), (2, "METHOD", "shop.order", "b.py", 9), (3, "METHOD", "shop.cart", "b.py", 9), (4, "FILE", "a.py", "a.py", 1), (5, "METHOD", None, None, 1)], "id long, node_type string, name string, file string, size int")
    edges = spark.createDataFrame([(2, 1, "CALLS"), (3, 2, "CALLS"), (4, 1, "CONTAINS"), (5, 1, "HEURISTIC_CALLS")], "src long, dst long, edge_type string")
    facts = spark.createDataFrame([(1, "a.py", "law", None, None, 1, "2024-01-01"), (2, "a.py", "observation", 1.0, None, 1, "2024-01-02")], "id long, file string, tier string, weight double, expired string, grain int, valid_at string")
    touches = spark.createDataFrame([(c, f"2024-01-0{c}", i) for c in (1, 2, 3) for i in (1, 2)], "commit long, ts string, item long").selectExpr("commit", "cast(ts as timestamp) as ts", "item")
    return Engine(spark, nodes, edges, touches, facts)


def test_arguments_are_checked():
    assert validate("search_code", {"query": "x"}) == {"query": "x", "limit": 30}
    for tool, given in (("nope", {}), ("explore", {}), ("explore", {"query": 1}), ("search_code", {"query": "x", "limit": 101}), ("search_code", {"query": "x", "limit": True}), ("neighbours", {"symbol": "x", "direction": "up"}), ("explore", {"query": "x", "y": 1})):
        with pytest.raises(ValueError):
            validate(tool, given)


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_every_tool_answers(engine, spark):
    assert ids(engine.call("neighbours", symbol="charge")) == [2, 4]
    assert ids(engine.call("neighbours", symbol="charge", depth=2, include_heuristic=True, direction="in")) == [2, 4, 5, 3]
    assert set(ids(engine.call("blast_radius", symbols=["charge"]))) == {2, 3, 4, 5}
    assert set(ids(engine.call("blast_radius", symbols=["charge"], task_type="bugfix"))) == {2, 4, 5}
    assert ids(engine.call("changes_with", symbol="charge"), "dst") == [2]
    assert ids(engine.call("file_symbols", path="a.py", node_types=["METHOD"])) == [1]
    assert ids(engine.call("search_code", query="charge"))[0] == 1
    assert set(ids(engine.call("explore", query="order"))) == {1, 3}
    assert {"node", "edge", "god"} == set(ids(engine.call("overview"), "kind"))
    assert ids(engine.call("recall", file="a.py")) == [1]
    new = spark.createDataFrame([(2, "a.py", "observation", 4.0, None, 1, "2024-01-02")], engine.facts.schema)
    assert len(ids(engine.call("remember", facts=new))) == 2 and ids(engine.call("recall", file="a.py")) == [1, 2]
    assert TOOLS.keys() == {"explore", "search_code", "neighbours", "changes_with", "blast_radius", "recall", "remember", "file_symbols", "overview"}
