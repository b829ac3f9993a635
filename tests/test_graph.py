"""Graph loading, directions, reachability and paths; shortest paths against Dijkstra on random graphs."""

import heapq
import json
import random

import pytest
from pyspark.sql import functions as F

from wayframe.api import StreetGraph
from wayframe.functions.geo import direction_ew_first, direction_ns_first
from wayframe.operators import graphs as G
from wayframe.operators import paths as P
from wayframe.sources.graphs import graph_from_tables, read_graph


@pytest.fixture(scope="module")
def sample(spark):
    return StreetGraph(spark, "/nowhere/graph.json")


def test_sample_graph(spark, sample):
    s = sample.graph.stats().first()
    assert (s.n_nodes, s.n_edges, s.n_removed) == (6, 10, 0)
    cases = [("central_park", "library", True), ("central_park", "times_square", True), ("central_park", "nonexistent", False), ("museum", "museum", True), ("nonexistent", "nonexistent", False)]
    got = sample.reachable_pairs(spark.createDataFrame([c[:2] for c in cases], "start string, end string")).collect()
    assert {(r.start, r.end): r.reachable for r in got} == {c[:2]: c[2] for c in cases}
    path = sample.compute_shortest_path("central_park", "station")
    assert path == ["central_park", "museum", "library", "station"]
    assert sample.get_path_length(path) == pytest.approx(4356.606, abs=1e-3)
    assert sample.get_path_length(["museum"]) == 0.0
    assert sample.compute_shortest_path("museum", "nowhere") == []
    step = sample.navigation_decisions(spark.createDataFrame([("central_park", "station"), ("museum", "museum")], "start string, end string")).collect()
    assert [(r.start, r.step, r.direction) for r in step] == [("central_park", "museum", "S")]
    assert sample.get_node_coordinates("museum") == (40.7794, -73.9632) and sample.get_node_coordinates("x") is None


def test_directions(spark):
    cases = [(40.7829, -73.9654, 40.7950, -73.9654, "N", "N"), (40.7829, -73.9654, 40.7794, -73.9632, "S", "S"), (40.7829, -73.9654, 40.7829, -73.9754, "W", "W"), (1.0, 1.0, 1.0, 1.0, "S", "W"), (0.0, 0.0, 1.0, 1.0, "N", "E"), (0.0, 0.0, -1.0, -1.0, "S", "W")]
    rows = spark.createDataFrame(cases, "a double, b double, c double, d double, x string, y string")
    ends = [F.col(c) for c in "abcd"]
    for r in rows.select("x", "y", direction_ns_first(*ends).alias("p"), direction_ew_first(*ends).alias("q")).collect():
        assert (r.p, r.q) == (r.x, r.y)


def test_graph_files(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"nodes": {"a": {"lat": 1, "lon": 2, "name": "A", "kind": "k"}, "b": {"lat": 1.5, "lon": 2}}, "edges": {"a": ["b", "zzz"], "q": ["a"]}}))
    g = read_graph(spark, str(path))
    assert {(r.src, r.dst) for r in g.edges.collect()} == {("a", "b"), ("q", "a")}  # unknown sources stay
    assert {r.id: (r.lat, r.name, r.attrs) for r in g.nodes.collect()} == {"a": (1.0, "A", {"kind": "k"}), "b": (1.5, None, {})}
    (tmp_path / "g.pkl").write_text("")
    with pytest.raises(ValueError):
        read_graph(spark, str(tmp_path / "g.pkl"))


def test_aliases(spark):
    raw = spark.createDataFrame([(1, 0.0, None, 5.0, 1.0), (2, None, None, 0.0, 1.0), (3, 0.0, None, None, 1.0), (4, 0.0, 7.0, 5.0, 0.0)], "id int, lat double, latitude double, y double, x double")
    assert {r.id: (r.lat, r.lon, r.name) for r in G.normalise_nodes(raw).collect()} == {"1": (5.0, 1.0, "Node_1"), "2": (0.0, 1.0, "Node_2"), "4": (7.0, 0.0, "Node_4")}
    edges = spark.createDataFrame([(1, 2), (1, 3), (3, 2), (1, 9)], "src int, dst int")
    assert {(r.src, r.dst) for r in graph_from_tables(raw, edges).edges.collect()} == {("1", "2")}


def test_shortest_paths_are_dijkstra(spark):
    rng = random.Random(4)
    edges = [(a, b, float(rng.choice([0, 0, 1, 1, 2, 5]))) for a in range(14) for b in rng.sample(range(14), 3)]
    got = {(r.source, r.id): (r.dist, r.path) for r in P.shortest_paths(spark.createDataFrame([(0,), (5,)], "id int"), spark.createDataFrame(edges, "src int, dst int, w double")).collect()}
    w = {}
    for a, b, x in edges:
        w[a, b] = min(x, w.get((a, b), x))
    for source in (0, 5):
        dist, heap = {}, [(0.0, source)]
        while heap:
            d, n = heapq.heappop(heap)
            if n not in dist:
                dist[n] = d
                for (a, b), x in w.items():
                    if a == n and b not in dist:
                        heapq.heappush(heap, (d + x, b))
        mine = {n: v for (s, n), v in got.items() if s == source}
        assert {n: d for n, (d, _) in mine.items()} == dist
        for n, (d, path) in mine.items():
            assert path[0] == source and path[-1] == n and len(set(path)) == len(path)
            assert sum(w[e] for e in zip(path, path[1:])) == d


def test_length_weights_and_pick(spark):
    rows = spark.createDataFrame([("a", "b", 3.0), ("a", "b", 2.0), ("b", "c", None)], "src string, dst string, length double")
    assert {(r.src, r.w) for r in P.by_length(rows).collect()} == {("a", 2.0), ("b", 1.0)}
    nodes = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, id string")
    assert P.pick(nodes, [1]).first().id == "b"
    with pytest.raises(ValueError):
        P.pick(nodes, [0, 500])
