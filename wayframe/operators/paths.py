"""Reachability and shortest paths of many pairs of nodes at once.

The graph is cut into cells (see cells.py). A round searches all cells to which the last one made
better offers, from all sources at once, so there are as many rounds as a path has changes of
cell, however many edges it has; sources whose pairs are answered stop. Tables between rounds are
written to the shared folder and deleted afterwards. A path is put together from its stretches in
cells, by doubling.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..session import deleted, written
from .cells import END, OFFER, Cells, cut, search

#: A guard: a search takes MOST_ROUNDS rounds at most, and a path HOPS edges for each of them.
HOPS, MOST_ROUNDS = 4, 10_000_000


def _known(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Different pairs whose ends are both nodes."""
    ids = nodes.select("id")
    return pairs.select("start", "end").distinct().join(ids.select(F.col("id").alias("start")), "start", "left_semi").join(ids.select(F.col("id").alias("end")), "end", "left_semi").select("start", "end")


def _checked(seen: dict[str, int]) -> None:
    if (seen["hops"] or 0) > HOPS * MOST_ROUNDS:
        raise RuntimeError(f"a path takes more than {MOST_ROUNDS} rounds of {HOPS} edges")


@dataclass
class _Searched:
    """offers(kind, source, id, cell, dist, hops, last, first, changed): the best offer to each node with edges from other cells, and of kind END the ends reached. open_offers: those within the bounds. bounds(source, bound): of sources all of whose ends are reached."""

    cells: Cells
    offers: DataFrame
    open_offers: DataFrame
    ends: DataFrame | None
    bounds: DataFrame | None
    n_sources: int
    used: list[str]


def _search_cells(sources: DataFrame, steps: DataFrame, n_edges: int, ends: DataFrame | None, once: bool) -> _Searched:
    """Rounds over cells until no offer gets better. steps: ``src, dst, w`` without loops, a row a pair. once: that a node is reached is enough."""
    cells = cut(steps, n_edges)
    used, kind = cells.used, steps.schema["src"].dataType
    none = F.lit(None).cast(kind)
    if ends is not None:
        counts = ends.groupBy("source").agg(F.count(F.lit(1)).alias("n_ends"))
        ends, path, _ = written(cells.placed(ends.select(F.col("source").cast(kind).alias("source"), F.col("id").cast(kind).alias("id")).join(counts, "source"), "id"), "ends")
        used.append(path)
    begin = cells.placed(sources.select(F.col("id").cast(kind).alias("id")).distinct(), "id")
    begin = begin.select(F.lit(OFFER).alias("kind"), F.col("id").alias("source"), "id", "cell", F.lit(0.0).alias("dist"), F.lit(0).cast("long").alias("hops"), none.alias("last"), none.alias("first"), F.lit(True).alias("changed"))
    offers, path, seen = written(begin, "offers", n=F.count(F.lit(1)))
    n_sources, last_path = seen["n"], path
    value = lambda: F.struct("dist", "hops", "last", "first")

    def within(offers: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        rows = offers.where(F.col("kind") == OFFER)
        if ends is None:
            return rows, None
        reached = offers.where(F.col("kind") == END).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("bound"))
        bounds = reached.join(ends.select("source", "n_ends").distinct(), "source").where("n = n_ends").select("source", "bound")
        if once:
            return rows.join(bounds, "source", "left_anti"), bounds
        return rows.join(bounds, "source", "left").where("bound IS NULL OR dist <= bound").drop("bound"), bounds

    open_offers, bounds = within(offers)
    rounds = 0
    while seen["n"] and (once or not cells.whole):  # where no edge leaves its cell, one search is all
        if rounds == MOST_ROUNDS:
            raise RuntimeError(f"a search did not settle in {MOST_ROUNDS} rounds")
        rounds += 1
        fresh = open_offers.where("changed").select("source", "cell").distinct()
        made = search(cells, open_offers.join(fresh, ["source", "cell"], "left_semi"), ends, n_sources, "offers")
        both = offers.drop("changed").withColumn("old", F.lit(1)).unionByName(made.withColumn("old", F.lit(0)))
        # Of equal offers the new one stays, as the same node makes it.
        best = both.groupBy("kind", "source", "id", "cell").agg(F.min(F.struct("dist", "hops", "last", "old", "first")).alias("best"), F.max(F.when(F.col("old") == 1, value())).alias("was"))
        now = best.select("kind", "source", "id", "cell", "best.dist", "best.hops", "best.last", "best.first", "was")
        changed = F.col("was").isNull() if once else ~value().eqNullSafe(F.col("was"))
        now = now.withColumn("changed", changed & (F.col("kind") == OFFER)).drop("was")
        offers, path, seen = written(now, "offers", n=F.count_if("changed"), hops=F.max("hops"))
        _checked(seen)
        deleted(sources.sparkSession, [last_path])
        last_path = path
        open_offers, bounds = within(offers)
    return _Searched(cells, offers, open_offers, ends, bounds, n_sources, [*used, last_path])


def reachability(pairs: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``start, end, reachable`` for ``pairs(start, end)``: an unknown end gives false, a known node reaches itself. A null end or an empty table of pairs is allowed."""
    steps, path, seen = written(edges.where("src <> dst").select("src", "dst", F.lit(0.0).alias("w")).distinct(), "steps", n=F.count(F.lit(1)))
    known, other, _ = written(_known(pairs, nodes), "pairs")
    ends = known.where("start <> end").select(F.col("start").alias("source"), F.col("end").alias("id"))
    found = _search_cells(ends.select(F.col("source").alias("id")), steps, seen["n"], ends, once=True)
    hit = found.offers.where(F.col("kind") == END).select(F.col("source").alias("start"), F.col("id").alias("end"))
    hit = hit.unionByName(known.where("start = end")).distinct().withColumn("hit", F.lit(True))
    out, _, _ = written(pairs.select("start", "end").join(hit, ["start", "end"], "left").select("start", "end", F.coalesce("hit", F.lit(False)).alias("reachable")), "reachable")
    deleted(pairs.sparkSession, [path, other, *found.used])
    return out


def geographic(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst, w``: edges between known nodes, weighted by great-circle metres."""
    from .graphs import with_ends

    return with_ends(edges.select("src", "dst"), nodes).select("src", "dst", haversine(*map(F.col, ("lat1", "lon1", "lat2", "lon2"))).alias("w"))


def by_length(edges: DataFrame) -> DataFrame:
    """``src, dst, w`` by the stored column length: a missing one, or column, counts as 1, of parallel edges the least."""
    length = F.coalesce("length", F.lit(1.0)) if "length" in edges.columns else F.lit(1.0)
    return edges.groupBy("src", "dst").agg(F.min(length).alias("w"))


def _shortest(sources: DataFrame, weighted: DataFrame, ends: DataFrame | None, result: str) -> tuple[DataFrame, str, int]:
    """The nodes or paths (see cells.search) that the sources reach, their table's path, and how many of the rows begin in another cell."""
    bad = F.col("w").isNull() | (F.col("w") < 0) | F.isnan("w")
    steps, path, seen = written(weighted.where("src <> dst").groupBy("src", "dst").agg(F.min(F.col("w").cast("double")).alias("w"), F.max(bad).alias("bad")), "steps", bad=F.count_if("bad"), n=F.count(F.lit(1)))
    if seen["bad"]:
        raise ValueError("a weight is missing, negative or not a number")
    if ends is not None:
        ends = ends.select("source", "id").distinct()
    found = _search_cells(sources, steps.drop("bad"), seen["n"], ends, once=False)
    rows = search(found.cells, found.open_offers, found.ends, found.n_sources, result)
    if found.bounds is not None:
        # What lies beyond a source's ends isn't settled everywhere.
        rows = rows.join(found.bounds, "source", "left").where("bound IS NULL OR dist <= bound").drop("bound")
    out, table, seen = written(rows, result, hops=F.max("hops"), left=F.count("at" if result == "paths" else F.lit(None)))
    _checked(seen)
    deleted(sources.sparkSession, [path, *found.used])
    return out, table, seen["left"]


def shortest_distances(sources: DataFrame, weighted: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """``source, id, dist, hops, last, first`` from each source to the nodes that it reaches; last: the node before, first: the first one after the source, both null at the source.

    Of equally short paths one with the fewest edges is taken, then the least node before. ends:
    ``source, id`` pairs of interest; nodes farther from a source than all of these needn't be
    there. ValueError for a weight that is null, negative or not a number.
    """
    return _shortest(sources, weighted, ends, "nodes")[0]


def shortest_paths(sources: DataFrame, weighted: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """``source, id, dist, path`` from each source to the nodes that it reaches (see shortest_distances), or, with ends, to those at least; a path never visits a node twice.

    Cells give the stretches of paths in them. Each round doubles the part of a path that a row
    holds, until it begins at the source. The rows together hold as many nodes as the paths have.
    """
    spark = sources.sparkSession
    held, path, left = _shortest(sources, weighted, ends, "paths")
    while left:
        before = path
        ahead = held.select("source", F.col("id").alias("at"), F.col("at").alias("then"), F.col("tail").alias("head"))
        joined = held.join(ahead, ["source", "at"], "left")
        held, path, seen = written(joined.select("source", "id", "dist", F.col("then").alias("at"), F.when(F.col("head").isNull(), F.col("tail")).otherwise(F.concat("head", "tail")).alias("tail")), "pointers", n=F.count("at"))
        deleted(spark, [before])
        left = seen["n"]
    return held.select("source", "id", "dist", F.col("tail").alias("path"))


def _answered(pairs: DataFrame, weighted: DataFrame, nodes: DataFrame, search_) -> DataFrame:
    """``start, end`` and the rows of search_ for different known pairs of ``pairs(start, end)``."""
    known = _known(pairs, nodes)
    rows = search_(known.select(F.col("start").alias("id")), weighted, known.select(F.col("start").alias("source"), F.col("end").alias("id")))
    return known.join(rows.withColumnsRenamed({"source": "start", "id": "end"}), ["start", "end"])


def paths_between(pairs: DataFrame, weighted: DataFrame, nodes: DataFrame) -> DataFrame:
    """``start, end, path, dist, found`` for ``pairs(start, end)``: an empty path where an end is unknown or not reached, the node alone from itself."""
    reached = _answered(pairs, weighted, nodes, shortest_paths)
    none = F.array().cast(reached.schema["path"].dataType)
    return pairs.join(reached, ["start", "end"], "left").select("start", "end", F.coalesce("path", none).alias("path"), "dist", F.col("path").isNotNull().alias("found"))


def distances_between(pairs: DataFrame, weighted: DataFrame, nodes: DataFrame) -> DataFrame:
    """``start, end, n_nodes, first, dist, found`` of paths_between's paths, without putting these together: n_nodes is 0 and first null where there is no path."""
    reached = _answered(pairs, weighted, nodes, shortest_distances)
    n_nodes = F.coalesce(F.col("hops") + 1, F.lit(0).cast("long"))
    return pairs.join(reached, ["start", "end"], "left").select("start", "end", n_nodes.alias("n_nodes"), "first", "dist", F.col("hops").isNotNull().alias("found"))


def path_lengths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``path_id, metres`` of ``paths(path_id, path)``: sums over neighbours in the list, whether or not there are edges; pairs with an unknown node count nothing; under two nodes 0."""
    places = paths.select("path_id", F.posexplode("path").alias("pos", "id")).join(nodes.select("id", "lat", "lon"), "id", "left")
    ahead = Window.partitionBy("path_id").orderBy("pos")
    step = haversine(F.col("lat"), F.col("lon"), F.lead("lat").over(ahead), F.lead("lon").over(ahead))
    sums = places.select("path_id", step.alias("m")).groupBy("path_id").agg(F.sum("m").alias("m"))
    return paths.select("path_id").join(sums, "path_id", "left").select("path_id", F.coalesce("m", F.lit(0.0)).alias("metres"))


def first_step(path: Column) -> Column:
    """The second node of a path, null if there is none."""
    return F.try_element_at(path, F.lit(2))


def first_directions(paths: DataFrame, nodes: DataFrame, rule) -> DataFrame:
    """``start, end, step, direction`` of ``paths(start, end, path)``, or ``(start, end, first)``, with two nodes at least."""
    step = F.col("first") if "first" in paths.columns else first_step(F.col("path"))
    steps = paths.select("start", "end", step.alias("step")).where("step IS NOT NULL")
    a = nodes.select(F.col("id").alias("start"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = nodes.select(F.col("id").alias("step"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return steps.join(a, "start").join(b, "step").select("start", "end", "step", rule(*map(F.col, ("lat1", "lon1", "lat2", "lon2"))).alias("direction"))


def pick(nodes: DataFrame, places: list[int]) -> DataFrame:
    """The nodes at these places of ``nodes(pos, id, ...)``; ValueError if one is missing."""
    rows = nodes.where(F.col("pos").isin(places))
    if rows.select("pos").distinct().count() < len(set(places)):
        raise ValueError(f"the graph has no node at one of the places {places}")
    return rows
