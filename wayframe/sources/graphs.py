"""Street graphs: JSON files of nodes and adjacency, node and edge tables, the built-in sample."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators.graphs import conversion_stats, graph_stats, normalise_nodes, symmetric, valid_edges

# The sample graph.
SAMPLE_NODES = [
    ("central_park", 40.7829, -73.9654, "Central Park"),
    ("museum", 40.7794, -73.9632, "Museum"),
    ("library", 40.7532, -73.9822, "Library"),
    ("station", 40.7580, -73.9855, "Station"),
    ("park_north", 40.7950, -73.9654, "Park North"),
    ("times_square", 40.7580, -73.9855, "Times Square"),
]
SAMPLE_LINKS = [("central_park", "museum"), ("central_park", "park_north"), ("museum", "library"), ("library", "station"), ("station", "times_square")]


@dataclass
class Graph:
    """nodes(id, lat, lon, name, ...) and edges(src, dst, pos); pos: a neighbour's place in its source's list."""

    nodes: DataFrame
    edges: DataFrame

    def stats(self) -> DataFrame:
        return graph_stats(self.edges, self.nodes)


def sample_graph(spark: SparkSession) -> Graph:
    links = spark.createDataFrame([(k, *link) for k, link in enumerate(SAMPLE_LINKS)], "pos int, src string, dst string")
    return Graph(spark.createDataFrame(SAMPLE_NODES, schemas.NODES), numbered(symmetric(links, "pos")))


def numbered(edges: DataFrame) -> DataFrame:
    """``src, dst, pos``: pos counts each source's neighbours from 0 in the order of pos (then dst). Neighbours of one source are ordered together."""
    return edges.select("src", "dst", (F.row_number().over(Window.partitionBy("src").orderBy("pos", "dst")) - 1).alias("pos"))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_graph(spark: SparkSession, path: str) -> Graph:
    """A graph from a ``.json`` file ``{"nodes": {id: {...}}, "edges": {id: [id, ...]}}``; edges to unknown nodes go. Or from a folder that holds nodes and edges as ``.jsonl`` or ``.parquet`` (see read_tables).

    A path that isn't there gives the sample graph. A .json is one record, which one task reads;
    large graphs come as tables. Pickles aren't read, as loading one runs code that it holds:
    export tables by export_script. ValueError for other kinds.
    """
    if not exists(spark, path):
        return sample_graph(spark)
    for kind in ("parquet", "jsonl"):
        nodes, edges = (f"{path.rstrip('/')}/{name}.{kind}" for name in ("nodes", "edges"))
        if exists(spark, nodes) and exists(spark, edges):
            return read_tables(spark, nodes, edges)
    if not path.endswith(".json"):
        raise ValueError(f"a graph can't be read from this kind of file: {path}")
    raw = spark.read.schema(schemas.GRAPH_FILE).option("multiLine", True).json(path)
    each = raw.select(F.explode("nodes").alias("id", "n"))
    nodes = each.select("id", F.col("n")["lat"].cast("double").alias("lat"), F.col("n")["lon"].cast("double").alias("lon"), F.col("n")["name"].alias("name"), F.map_filter("n", lambda k, _: ~k.isin("lat", "lon", "name")).alias("attrs"))
    edges = raw.select(F.explode("edges").alias("src", "to")).select("src", F.posexplode("to").alias("pos", "dst")).select("src", "dst", "pos")
    return Graph(nodes, valid_edges(edges, nodes))


def write_graph(graph: Graph, path: str) -> None:
    """A graph as a ``.json`` that read_graph reads: one record, so for small graphs; tables are for others. Columns of nodes but id become attributes, nulls go."""
    attributes = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in graph.nodes.columns if c != "id"]))
    node = F.struct("id", F.map_filter(attributes, lambda _, v: v.isNotNull()))
    nodes = graph.nodes.agg(F.map_from_entries(F.collect_list(node)).alias("nodes"))
    lists = graph.edges.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("to"))
    edges = lists.agg(F.map_from_entries(F.collect_list(F.struct("src", "to"))).alias("edges"))
    one = nodes.withColumn("k", F.lit(0)).join(edges.withColumn("k", F.lit(0)), "k")  # a row each
    one.select(F.to_json(F.struct("nodes", "edges"))).coalesce(1).write.text(path)


def graph_from_tables(raw_nodes: DataFrame, raw_edges: DataFrame) -> Graph:
    """From tables with coordinate aliases (see normalise_nodes) and ``src, dst[, pos]``; edges with an end that is no valid node go.

    Tables have no order of their own: without a column pos a source's neighbours are ordered by
    dst. This is also the way in for graphs pickled by other libraries: export_script() gives a
    program that writes such tables where that library is at hand.
    """
    nodes = normalise_nodes(raw_nodes)
    named = _named(raw_edges)
    if "pos" not in raw_edges.columns:
        named = named.withColumn("pos", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).cast("int"))
    return Graph(nodes, valid_edges(named.withColumn("pos", F.col("pos").cast("int")), nodes, both=True))


def _named(raw_edges: DataFrame) -> DataFrame:
    """Edges with ends as text, and pos after them."""
    rest = [c for c in raw_edges.columns if c not in ("src", "dst", "pos")]
    return raw_edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), *["pos"] * ("pos" in raw_edges.columns), *rest)


def table_stats(raw_nodes: DataFrame, raw_edges: DataFrame) -> DataFrame:
    """One row of graph_from_tables' counts: nodes, edges, and edges skipped as their target has no coordinates or doesn't exist."""
    return conversion_stats(_named(raw_edges), normalise_nodes(raw_nodes))


def export_script() -> str:
    """A Python program that writes a pickled graph (or a dict with nodes and edges) as nodes.jsonl and edges.jsonl for read_tables; to be run where the pickle is trusted."""
    return '''import json, pickle, sys

with open(sys.argv[1], "rb") as f:  # loading a pickle runs code that it holds
    graph = pickle.load(f)
if isinstance(graph, dict):
    nodes = graph["nodes"].items()
    edges = [(a, b, k, {}) for a, out in graph["edges"].items() for k, b in enumerate(out)]
else:
    nodes = graph.nodes(data=True)
    edges = [(a, b, k, graph.get_edge_data(a, b) or {}) for a in graph.nodes for k, b in enumerate(graph.neighbors(a))]
with open(sys.argv[2] + "/nodes.jsonl", "w") as out:
    for place, (name, data) in enumerate(nodes):
        out.write(json.dumps({"id": str(name), "place": place, **{k: v for k, v in data.items() if isinstance(v, (int, float, str))}}) + "\\n")
with open(sys.argv[2] + "/edges.jsonl", "w") as out:
    for a, b, k, data in edges:
        lengths = [d.get("length") for d in (data.values() if all(isinstance(d, dict) for d in data.values()) else [data]) if d.get("length") is not None]
        out.write(json.dumps({"src": str(a), "dst": str(b), "pos": k, "length": min(lengths, default=None)}) + "\\n")
'''


def read_tables(spark: SparkSession, nodes: str, edges: str) -> Graph:
    """A graph from two files or folders of JSON lines or Parquet (by the name's end): nodes with coordinate aliases, edges ``src, dst[, pos, length]``. Both are read in parallel."""
    read = lambda path: spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.json(path)
    return graph_from_tables(read(nodes), read(edges))
