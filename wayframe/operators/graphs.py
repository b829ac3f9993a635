"""Cleaning and looking up street graphs kept as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that name coordinates, in order of preference; they aren't kept as attributes.
LATITUDES, LONGITUDES = ("lat", "latitude", "y"), ("lon", "longitude", "x")


def _coordinate(rows: DataFrame, names: tuple[str, ...]):
    """The first usable alias as a number: a zero or an empty text in any but the last falls through."""
    have = [n for n in names if n in rows.columns]
    if not have:
        return F.lit(None).cast("double")

    def usable(n: str):
        c = F.col(n).cast("string")
        if n == names[-1]:
            return c
        plain = rows.schema[n].dataType.simpleString() == "string"  # a text "0" is a value, a number 0 is not
        return F.when(c.isNotNull() & (c != ""), c) if plain else F.when(F.col(n) != 0, c)

    return F.coalesce(*[usable(n) for n in have]).cast("double")


def normalise_nodes(raw: DataFrame) -> DataFrame:
    """``id, lat, lon, name`` and other attributes, for nodes with both coordinates. id is text; without a name column the name is ``Node_<id>`` (a null name stays null)."""
    extra = [c for c in raw.columns if c not in (*LATITUDES, *LONGITUDES, "id", "name")]
    name = F.col("name") if "name" in raw.columns else F.concat(F.lit("Node_"), F.col("id").cast("string"))
    return raw.select(F.col("id").cast("string").alias("id"), _coordinate(raw, LATITUDES).alias("lat"), _coordinate(raw, LONGITUDES).alias("lon"), name.alias("name"), *extra).where("lat IS NOT NULL AND lon IS NOT NULL")


def valid_edges(edges: DataFrame, nodes: DataFrame, both: bool = False) -> DataFrame:
    """Edges whose target is a node; both: and whose source is."""
    ids = nodes.select("id")
    out = edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return (out.join(ids.select(F.col("id").alias("src")), "src", "left_semi") if both else out).select(edges.columns)


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target isn't a node."""
    return edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select(edges.columns)


def graph_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges kept, edges removed."""
    marked = edges.join(nodes.select(F.col("id").alias("dst"), F.lit(1).alias("known")), "dst", "left")
    kinds = nodes.select(F.lit("node").alias("kind")).union(marked.select(F.when(F.col("known").isNull(), "removed").otherwise("edge")))
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    return kinds.agg(count("node").alias("n_nodes"), count("edge").alias("n_edges"), count("removed").alias("n_removed"))


def node_coordinates(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """ids with ``lat, lon``, null for unknown ids."""
    return ids.join(nodes.select("id", "lat", "lon"), "id", "left")


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with ``lat1, lon1, lat2, lon2``; edges with an unknown end go."""
    a = nodes.select(F.col("id").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = nodes.select(F.col("id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return edges.join(a, "src").join(b, "dst")


def neighbours(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, dst, pos`` of all edges from ids."""
    return ids.join(edges, F.col("id") == F.col("src")).select("id", "dst", "pos")


def symmetric(edges: DataFrame, *others: str) -> DataFrame:
    """Each edge in both directions, as a bag; others: columns that both keep."""
    return edges.select("src", "dst", *others).union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others))


def first_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.min_by("dst", "pos").alias("dst"))


def conversion_stats(raw_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges between nodes, and edges skipped as their target is no node (those of sources that are none aren't looked at)."""
    return graph_stats(raw_edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi"), nodes).withColumnRenamed("n_removed", "n_skipped")
