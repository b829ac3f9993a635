"""A graph cut into cells that a task can hold, and searches within cells.

A cell is a connected part of a range of ids with about MOST_EDGES edges at most, so small
components are cells of their own. A search (Dijkstra, by length, then number of edges) settles
one source in one cell from what other cells offer to the cell's nodes; what it offers to others
in turn is a row for each node that an edge out of the cell leads to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

#: Edges that a range of ids has, about (a node's edges stay together). Sources that a task searches in a cell, about; groups of sources at most.
MOST_EDGES, SOURCES_AT_ONCE, MOST_GROUPS = 500_000, 16, 256
#: Rows, and nodes of paths, that a batch of results holds, about.
ROWS, STRETCH = 20_000, 1_000_000
EDGE, OFFER, END = 0, 1, 2


@dataclass
class Cells:
    """edges(src, dst, w, cell, next): next is dst's cell. places(id, cell). whole: no edge leaves its cell. used: paths of the tables."""

    edges: DataFrame
    places: DataFrame
    blocks: int
    used: list[str] = field(default_factory=list)

    @property
    def whole(self) -> bool:
        return self.blocks == 1

    def placed(self, rows: DataFrame, of: str) -> DataFrame:
        """rows with the cell of the node in column of; nodes without edges are spread over cells of their own."""
        own = rows.join(self.places.withColumnRenamed("id", of), of, "left")
        return own.withColumn("cell", F.coalesce("cell", -1 - F.pmod(F.xxhash64(of), F.lit(1024))))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, cell`` of ``block, src, dst`` sorted by block: nodes of a block that its edges connect share a cell."""
    up: dict = {}
    now = kind = None

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    def found():
        number = {}
        cells = [(now << 32) + number.setdefault(root(x), len(number)) for x in list(up)]
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array(cells, pa.int64())], ["id", "cell"])

    for batch in batches:
        kind = batch.schema.field(1).type
        for block, a, b in zip(*[c.to_pylist() for c in batch.columns]):
            if block != now:
                yield from found()
                up.clear()
                now = block
            a, b = root(a), root(b)
            if a != b:
                up[a] = b
    yield from found()


def cut(steps: DataFrame, n: int) -> Cells:
    """Cells of ``steps(src, dst, w)``, n different edges."""
    blocks, used = max(1, math.ceil(n / MOST_EDGES)), []
    if blocks == 1:
        rows = steps.select(F.lit(0).cast("long").alias("block"), "src", "dst")
    else:
        each = steps.select(F.explode(F.array("src", "dst")).alias("id")).repartitionByRange(blocks, "id")
        ranges, path, _ = written(each.select("id", F.spark_partition_id().cast("long").alias("block")).distinct(), "ranges")
        used.append(path)
        a, b = ranges.select(F.col("id").alias("src"), "block"), ranges.select(F.col("id").alias("dst"), F.col("block").alias("other"))
        inner = steps.select("src", "dst").join(a, "src").join(b, "dst").where("block = other").select("block", "src", "dst")
        rows = inner.unionByName(ranges.select("block", F.col("id").alias("src"), F.col("id").alias("dst")))
    kind = T.StructType([T.StructField("id", steps.schema["src"].dataType), T.StructField("cell", T.LongType())])
    places, path, _ = written(rows.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(_pieces, kind), "cells")
    used.append(path)
    edges = steps.join(places.withColumnRenamed("id", "src"), "src")
    there = places.select(F.col("id").alias("dst"), F.col("cell").alias("next"))
    edges = edges.withColumn("next", F.col("cell")) if blocks == 1 else edges.join(there, "dst")
    edges, path, _ = written(edges.select("src", "dst", "w", "cell", "next"), "steps")
    used.append(path)
    return Cells(edges, places, blocks, used)


def _settle(inner: dict, outer: dict, offers: dict, ends: set, n_ends: int) -> tuple[dict, dict]:
    """``{node: (dist, hops, last, first)}`` of a cell's nodes, in the order in which they were settled, and the least offers to nodes of other cells, ``{node: (dist, hops, last, first, cell)}``.

    Where all n_ends ends of the source are here, nodes farther than these are left out.
    """
    best, settled, out = dict(offers), {}, {}
    heap = [(d, h, n) for n, (d, h, _, _) in offers.items()]
    heapify(heap)
    waits, bound = set(ends) if n_ends and len(ends) == n_ends else None, math.inf
    while heap:
        d, h, n = heappop(heap)
        if d > bound:
            break
        if n in settled:
            continue
        mine = settled[n] = best[n]
        first = mine[3]
        if waits:
            waits.discard(n)
            if not waits:
                bound = d
        d0, h = d, h + 1
        for to, w in inner.get(n, ()):
            d = d0 + w
            old = best.get(to)
            if old is None or d < old[0] or (d == old[0] and (h < old[1] or (h == old[1] and n < old[2]))):
                best[to] = (d, h, n, to if h == 1 else first)
                if old is None or d != old[0] or h != old[1]:
                    heappush(heap, (d, h, to))
        for to, w, cell in outer.get(n, ()):
            new = (d0 + w, h, n)
            if to not in out or new < out[to][:3]:
                out[to] = (*new, to if h == 1 else first, cell)
    return settled, out


def _trails(source, settled: dict, wanted: set | None) -> Iterator[tuple]:
    """``(columns, kind of id aside)`` of paths within the cell: for each wanted node its dist, hops, the node before the stretch, and the stretch as places in the list of settled nodes."""
    number = {n: k for k, n in enumerate(settled)}
    after: dict = {}
    roots = []
    for n, (_, _, last, _) in settled.items():
        (after.setdefault(last, []) if last in number else roots).append(n)
    way = np.empty(len(number), np.int64)
    for begin in roots:
        at, stack = settled[begin][2], [(begin, 0)]
        while stack:
            n, depth = stack.pop()
            way[depth] = number[n]
            if wanted is None or n in wanted:
                yield n, settled[n][0], settled[n][1], at, way[: depth + 1].copy()
            stack.extend((c, depth + 1) for c in after.get(n, ()))


def _searching(result: str, with_ends: bool):
    """A function for mapInArrow over rows of tasks(). result: offers (and ends reached), nodes or paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = who = kind = None
        inner, outer, offers, ends, n_ends = {}, {}, {}, set(), 0
        rows: list[tuple] = []

        def packed(names: dict):
            for k in range(0, len(rows), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + ROWS]), names.values())], list(names))
            rows.clear()

        def trails(stretches: list, ids: pa.Array):
            cols = list(zip(*rows))
            offsets = np.zeros(len(stretches) + 1, np.int32)
            np.cumsum([len(s) for s in stretches], out=offsets[1:])
            tail = pa.ListArray.from_arrays(pa.array(offsets), ids.take(pa.array(np.concatenate(stretches))))
            types = [kind, kind, pa.float64(), pa.int64(), kind]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, types)], tail], ["source", "id", "dist", "hops", "at", "tail"])
            rows.clear()
            stretches.clear()

        def answers():
            settled, out = _settle(inner, outer, offers, ends, n_ends)
            source = who[2]
            if result == "offers":
                rows.extend((OFFER, source, n, cell, d, h, last, first) for n, (d, h, last, first, cell) in out.items())
                rows.extend((END, source, n, who[0], *settled[n]) for n in ends if n in settled)
                if len(rows) >= ROWS:
                    yield from packed({"kind": pa.int32(), "source": kind, "id": kind, "cell": pa.int64(), "dist": pa.float64(), "hops": pa.int64(), "last": kind, "first": kind})
            elif result == "nodes":
                rows.extend((source, n, *v) for n, v in settled.items())
                if len(rows) >= ROWS:
                    yield from packed({"source": kind, "id": kind, "dist": pa.float64(), "hops": pa.int64(), "last": kind, "first": kind})
            else:
                stretches, held, ids = [], 0, pa.array(list(settled), kind)
                for n, d, h, at, stretch in _trails(source, settled, ends | outer.keys() if with_ends else None):
                    rows.append((source, n, d, h, at))
                    stretches.append(stretch)
                    held += len(stretch)
                    if held >= STRETCH or len(rows) >= ROWS:
                        yield from trails(stretches, ids)
                        held = 0
                if rows:
                    yield from trails(stretches, ids)

        for batch in batches:
            kind = batch.schema.field(4).type
            for cell, group, source, what, a, b, w, hops, first, to_cell in zip(*[c.to_pylist() for c in batch.columns]):
                if (cell, group, source) != who:
                    if offers:
                        yield from answers()
                    if (cell, group) != key:
                        key, inner, outer = (cell, group), {}, {}
                    who, offers, ends, n_ends = (cell, group, source), {}, set(), 0
                if what == EDGE:
                    if to_cell == cell:
                        inner.setdefault(a, []).append((b, w))
                    else:
                        outer.setdefault(a, []).append((b, w, to_cell))
                elif what == OFFER:
                    offers[a] = (w, hops, b, first)
                else:
                    ends.add(a)
                    n_ends = hops
        if offers:
            yield from answers()
        if rows and result == "offers":
            yield from packed({"kind": pa.int32(), "source": kind, "id": kind, "cell": pa.int64(), "dist": pa.float64(), "hops": pa.int64(), "last": kind, "first": kind})
        elif rows:
            yield from packed({"source": kind, "id": kind, "dist": pa.float64(), "hops": pa.int64(), "last": kind, "first": kind})

    return run


def search(cells: Cells, offers: DataFrame, ends: DataFrame | None, n_sources: int, result: str) -> DataFrame:
    """Searches each source's cells from ``offers(source, id, cell, dist, hops, last, first)``. ends: ``source, id, cell, n_ends``.

    Edges of a cell go once to each group of sources that is at work there; a task reads a cell's
    edges, then the offers of one source after another.
    """
    t = cells.edges.schema["src"].dataType
    none, groups = F.lit(None).cast(t), min(MOST_GROUPS, max(1, math.ceil(n_sources / SOURCES_AT_ONCE)))
    group = F.pmod(F.xxhash64("source"), F.lit(groups)).cast("int").alias("grp")
    cols = ["cell", "grp", "source", "kind", "a", "b", "w", "hops", "first", "next"]
    zero = F.lit(0).cast("long")
    asked = offers.select("cell", group, "source", F.lit(OFFER).alias("kind"), F.col("id").alias("a"), F.col("last").alias("b"), F.col("dist").alias("w"), "hops", "first", zero.alias("next"))
    rows = cells.edges.join(asked.select("cell", "grp").distinct(), "cell").select("cell", "grp", none.alias("source"), F.lit(EDGE).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "w", zero.alias("hops"), none.alias("first"), "next")
    rows = rows.unionByName(asked)
    if ends is not None:
        here = ends.join(offers.select("source", "cell").distinct(), ["source", "cell"], "left_semi")
        rows = rows.unionByName(here.select("cell", group, "source", F.lit(END).alias("kind"), F.col("id").alias("a"), none.alias("b"), F.lit(0.0).alias("w"), F.col("n_ends").alias("hops"), none.alias("first"), zero.alias("next")))
    parts = max(3 * rows.sparkSession.sparkContext.defaultParallelism, 2 * cells.blocks)
    rows = rows.select(cols).repartition(parts, "cell", "grp").sortWithinPartitions("cell", "grp", "source", "kind")
    node = [T.StructField("source", t), T.StructField("id", t)]
    reach = [T.StructField("dist", T.DoubleType()), T.StructField("hops", T.LongType())]
    made = {
        "offers": [T.StructField("kind", T.IntegerType()), *node, T.StructField("cell", T.LongType()), *reach, T.StructField("last", t), T.StructField("first", t)],
        "nodes": [*node, *reach, T.StructField("last", t), T.StructField("first", t)],
        "paths": [*node, *reach, T.StructField("at", t), T.StructField("tail", T.ArrayType(t))],
    }[result]
    return rows.mapInArrow(_searching(result, ends is not None), T.StructType(made))
