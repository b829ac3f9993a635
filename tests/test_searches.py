"""Searches on random graphs, their limits, and graphs that come as tables."""

import json
import pickle
import random
import subprocess
import sys

import pytest

from wayframe import session
from wayframe.operators import cells
from wayframe.operators import paths as P
from wayframe.sources import graphs as S


def edge_rows(seed, n=40, out=2):
    rng = random.Random(seed)
    return [(a, rng.randrange(n), float(rng.choice([0, 1, 2, 5, 0.5]))) for a in range(n) for _ in range(out)]


def test_reachability_is_a_search(spark):
    rows = edge_rows(3, out=1)
    after = {}
    for a, b, _ in rows:
        after.setdefault(a, set()).add(b)
    pairs = [(a, b) for a in range(0, 44, 3) for b in range(44)] + [(None, 1), (1, None)]
    got = P.reachability(spark.createDataFrame(pairs, "start int, end int"), spark.createDataFrame(rows, "src int, dst int, w double"), spark.createDataFrame([(k,) for k in range(40)], "id int")).collect()

    def reaches(a, b):
        if a is None or b is None or a >= 40 or b >= 40:
            return False
        seen, stack = {a}, [a]
        while stack:
            for x in after.get(stack.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        return b in seen

    assert sorted(((r.start, r.end, r.reachable) for r in got), key=repr) == sorted(((a, b, reaches(a, b)) for a, b in pairs), key=repr)


def test_bounded_search_finds_the_same_paths(spark):
    weighted = spark.createDataFrame(edge_rows(5), "src int, dst int, w double")
    nodes = spark.createDataFrame([(k,) for k in range(40)], "id int")
    full = {(r.source, r.id): r for r in P.shortest_paths(spark.createDataFrame([(0,), (7,), (9,)], "id int"), weighted).collect()}
    pairs = [(0, 1), (0, 30), (7, 8), (9, 9), (9, 99)]
    for r in P.paths_between(spark.createDataFrame(pairs, "start int, end int"), weighted, nodes).collect():
        want = full.get((r.start, r.end))
        assert r.found == (want is not None) and (want is None or (r.dist, r.path) == (want.dist, want.path))


@pytest.mark.parametrize("w", [-1.0, float("nan"), None])
def test_bad_weights(spark, w):
    with pytest.raises(ValueError):
        P.shortest_distances(spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(1, 2, 1.0), (2, 3, w)], "src int, dst int, w double"))


def test_rounds_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_ROUNDS", 2)
    line = spark.createDataFrame([(k, k + 1, 1.0) for k in range(30)], "src int, dst int, w double")
    with pytest.raises(RuntimeError):
        P.shortest_distances(spark.createDataFrame([(0,)], "id int"), line)
    with pytest.raises(RuntimeError):
        P.reachability(spark.createDataFrame([(0, 30)], "start int, end int"), line, spark.createDataFrame([(k,) for k in range(31)], "id int"))


def test_empty_tables(spark):
    weighted = spark.createDataFrame([], "src int, dst int, w double")
    none = spark.createDataFrame([], "start int, end int")
    nodes = spark.createDataFrame([(1,)], "id int")
    assert P.reachability(none, weighted, nodes).count() == 0 and P.paths_between(none, weighted, nodes).count() == 0
    assert [tuple(r) for r in P.shortest_paths(nodes, weighted).collect()] == [(1, 1, 0.0, [1])]


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        get = lambda self, key, default=None: default

    class Fake:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        session.shared_root(Fake)


def test_exported_tables(spark, tmp_path):
    """A pickled dict, exported by the documented program and read as tables."""
    graph = {"nodes": {"a": {"lat": 1.0, "lon": 2.0, "name": "A"}, "b": {"lat": 1.5, "lon": 2.5}, "c": {"name": "no place"}}, "edges": {"a": ["b", "c"], "b": ["a", "zzz"]}}
    (tmp_path / "g.pickle").write_bytes(pickle.dumps(graph))
    (tmp_path / "export.py").write_text(S.export_script())
    subprocess.run([sys.executable, str(tmp_path / "export.py"), str(tmp_path / "g.pickle"), str(tmp_path)], check=True, timeout=60)
    assert len((tmp_path / "nodes.jsonl").read_text().splitlines()) == 3 and json.loads((tmp_path / "edges.jsonl").read_text().splitlines()[0]) == {"src": "a", "dst": "b", "pos": 0, "length": None}
    made = S.read_graph(spark, str(tmp_path))
    assert sorted((r.src, r.dst, r.pos) for r in made.edges.collect()) == [("a", "b", 0), ("b", "a", 0)]
    s = S.table_stats(spark.read.json(str(tmp_path / "nodes.jsonl")), spark.read.json(str(tmp_path / "edges.jsonl"))).first()
    assert (s.n_nodes, s.n_edges, s.n_skipped) == (2, 2, 2)


def test_neighbour_order(spark):
    edges = {(r.src, r.pos): r.dst for r in S.sample_graph(spark).edges.collect()}
    assert [edges["museum", k] for k in range(2)] == ["central_park", "library"] and [edges["central_park", k] for k in range(2)] == ["museum", "park_north"]


def counted(monkeypatch):
    """How many tables searches write from now on."""
    made = []
    monkeypatch.setattr(P, "written", lambda *a, **k: made.append(1) or session.written(*a, **k))
    return made


def test_rounds_do_not_grow_with_distances(spark, monkeypatch):
    made = counted(monkeypatch)
    line = spark.createDataFrame([(k, k + 1, 1.0) for k in range(200)], "src int, dst int, w double")
    assert P.shortest_distances(spark.createDataFrame([(0,)], "id int"), line).where("dist = id AND hops = id AND (id = 0 OR last = id - 1 AND first = 1)").count() == 201
    assert P.reachability(spark.createDataFrame([(0, 200), (200, 0)], "start int, end int"), line, spark.range(201)).where("reachable").first().end == 200
    assert len(made) < 20  # 50 rounds a search before


@pytest.mark.parametrize("kind", ["int", "string"])
def test_cells_change_nothing(spark, monkeypatch, kind):
    """Searches in one cell and across many, from text and numbers: the same states, paths and answers, by plain code as well."""
    name = (lambda k: f"n{k:02}") if kind == "string" else int
    rows = [(name(a), name(b), w) for a, b, w in edge_rows(11, n=24)]
    weighted, nodes = spark.createDataFrame(rows, f"src {kind}, dst {kind}, w double"), spark.createDataFrame([(name(k),) for k in range(24)], f"id {kind}")
    sources = spark.createDataFrame([(name(k),) for k in (0, 7, 23, 77)], f"id {kind}")
    pairs = spark.createDataFrame([(name(a), name(b)) for a in (0, 7, 23) for b in (3, 8, 20, 23)], f"start {kind}, end {kind}")

    def results():
        found = [P.shortest_distances(sources, weighted), P.shortest_paths(sources, weighted), P.paths_between(pairs, weighted, nodes), P.distances_between(pairs, weighted, nodes), P.reachability(pairs, weighted, nodes)]
        return [sorted(map(tuple, f.collect()), key=repr) for f in found]

    whole = results()
    made = counted(monkeypatch)
    monkeypatch.setattr(cells, "MOST_EDGES", 24)
    assert (results() if kind == "int" else [sorted(map(tuple, P.shortest_distances(sources, weighted).collect()), key=repr)]) == whole[: 5 if kind == "int" else 1]
    assert len(made) > 10
    w = {}
    for a, b, x in rows:
        if a != b:
            w[a, b] = min(x, w.get((a, b), x))
    best = {(name(k), name(k)): (0.0, 0, None, None) for k in (0, 7, 23, 77)}
    for _ in range(80):
        for (s, a), (d, h, _, first) in list(best.items()):
            for (x, b), more in w.items():
                new = (d + more, h + 1, a, b if first is None else first)
                if x == a and b != s and ((s, b) not in best or new[:3] <= best[s, b][:3]):
                    best[s, b] = new
    assert {r[:2]: r[2:] for r in whole[0]} == best
    assert all(p[0] == s and p[-1] == n and len(p) == best[s, n][1] + 1 and (len(p) == 1 or (p[1], p[-2]) == (best[s, n][3], best[s, n][2])) for s, n, _, p in whole[1])
    assert [(r[2], r[5]) for r in whole[3]] == [(len(r[2]), r[4]) for r in whole[2]]
    assert [r[2] for r in whole[4]] == [r[4] for r in whole[2]]
