"""StreetGraph by stored lengths."""

from wayframe.api import StreetGraph
from wayframe.sources.graphs import graph_from_tables


def test_by_length(spark):
    nodes = spark.createDataFrame([("a", 40.0, 10.0), ("b", 41.0, 11.0), ("c", 40.0, 10.1)], "id string, lat double, lon double")
    edges = spark.createDataFrame([("a", "c", 9.0), ("a", "b", 2.0), ("b", "c", None)], "src string, dst string, length double")
    pairs = spark.createDataFrame([("a", "c")], "start string, end string")
    tables = StreetGraph(spark, graph_from_tables(nodes, edges))
    row = tables.path_pairs(pairs, by_length=True).first()
    assert (row.path, row.dist) == (["a", "b", "c"], 3.0)
    assert tables.path_pairs(pairs).first().path == ["a", "c"]
    assert tables.navigation_decisions(pairs, by_length=True).first().step == "b"


def test_without_lengths(spark):
    sample = StreetGraph(spark, "/nowhere/graph.json")
    row = sample.path_pairs(spark.createDataFrame([("central_park", "station")], "start string, end string"), by_length=True).first()
    assert (len(row.path), row.dist) == (4, 3.0)  # a missing length counts as 1
