"""Connected components by contraction of slim edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, shared_dir, stored


#: Edges (each counted in both directions) that one task may take.
AT_ONCE = 400_000


def _ends_of(edges: DataFrame) -> DataFrame:
    """``node, to`` for the nodes of a bounded number of edges, in one task: to is the least node of the component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in list(up)], kind)], ["node", "to"])

    node = edges.schema["a"].dataType
    return edges.select("a", "b").where("a < b").repartition(1).mapInArrow(run, T.StructType([T.StructField("node", node), T.StructField("to", node)]))


def connected_components(edges: DataFrame, most_rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """``node, label`` for each end of ``edges(a, b)``: label is the least node of its component.

    Each round sends every node to one of its neighbours or itself, the one that comes first in
    an order drawn anew for the round. Edges are rewritten to these targets, and loops and equal
    edges go, so the graph shrinks by a constant share a round in expectation, whatever its
    shape: a star vanishes at once. Once no more than at_once edges are left, whose number is
    counted, one task ends the work. The rounds' targets are then followed back. Tables between
    rounds are written to the shared folder and deleted once read; only counts return to the
    driver. Null ends and loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    path = shared_dir(spark, "edges")
    left = stored(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", path)
    paths, done, rounds = [path], [], []
    while n := left.count():
        if n <= at_once:
            done.append(shared_dir(spark, "moves"))
            rounds.append(stored(_ends_of(left), "moves", done[-1]))
            break
        if len(rounds) == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        drawn = lambda c, k=len(rounds): F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("to"))
        first = left.groupBy("a").agg(F.min(drawn("b")).alias("near"))
        done.append(shared_dir(spark, "moves"))
        moves = stored(first.select(F.col("a").alias("node"), F.least("near", drawn("a"))["to"].alias("to")), "moves", done[-1])
        rounds.append(moves)
        moved = left.join(moves.withColumnRenamed("node", "b"), "b").select("a", F.col("to").alias("b"))
        moved = moved.join(moves.withColumnRenamed("node", "a"), "a").select(F.col("to").alias("a"), "b")
        path = shared_dir(spark, "edges")
        left = stored(moved.where("a <> b").distinct(), "edges", path)
        discard(edges, paths[-1])
        paths.append(path)
    if not rounds:
        return ends.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    ended = rounds[-1]
    for moves in reversed(rounds[:-1]):
        later = ended.select(F.col("node").alias("to"), F.col("to").alias("end"))
        ended = moves.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    path = shared_dir(spark, "ends")
    ended = stored(ended, "ends", path)
    least = ended.groupBy("to").agg(F.min("node").alias("label"))
    labels = stored(ended.join(least, "to").select("node", "label"), "labels")
    for path in (path, *paths[-1:], *done):
        discard(edges, path)
    return labels
