"""The two entry points: instructions and their variants, street graphs and their paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geo import direction_ew_first, direction_ns_first
from .functions.text import degrade
from .operators import graphs, paths, variants
from .sources.graphs import Graph, read_graph
from .sources.instructions import read_instructions, write_variants


class InstructionDegrader:
    """Loads instructions; makes, reports and saves variants."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.data = spark, read_instructions(spark, path)

    def degrade_text(self, text: str, strategy: int) -> dict[str, str]:
        """One text by one strategy: ``underspecified`` and ``removed`` ("None" for nothing)."""
        r = degrade(self.spark.createDataFrame([(text,)], "text string"), "text").first()
        return {"underspecified": r[f"t{strategy}_text"], "removed": r[f"t{strategy}_removed"] or "None"}

    def generate(self, n_samples: int = 100) -> DataFrame:
        """Variants of n_samples instructions (all, if there are no more)."""
        return variants.expand(variants.sample_exactly(self.data, n_samples))

    def report(self, made: DataFrame) -> str:
        return "\n".join(variants.report_lines(made))

    def save(self, made: DataFrame, path: str, files: int | None = None) -> None:
        write_variants(made, path, files)


class StreetGraph:
    """Loads a graph, or takes one (as of graph_from_tables); answers reachability, shortest paths, lengths and directions, singly or for tables of pairs."""

    def __init__(self, spark: SparkSession, source: str | Graph):
        self.spark, self.graph = spark, source if isinstance(source, Graph) else read_graph(spark, source)

    def _pair(self, start: str, end: str) -> DataFrame:
        return self.spark.createDataFrame([(start, end)], "start string, end string")

    def reachable_pairs(self, pairs: DataFrame) -> DataFrame:
        return paths.reachability(pairs, self.graph.edges, self.graph.nodes)

    def check_reachability(self, start: str, end: str) -> bool:
        return self.reachable_pairs(self._pair(start, end)).first().reachable

    def _weighted(self, by_length: bool) -> DataFrame:
        return paths.by_length(self.graph.edges) if by_length else paths.geographic(self.graph.edges, self.graph.nodes)

    def path_pairs(self, pairs: DataFrame, by_length: bool = False) -> DataFrame:
        """Shortest paths by great-circle metres or, by_length, by the edges' column length."""
        return paths.paths_between(pairs, self._weighted(by_length), self.graph.nodes)

    def navigation_decisions(self, pairs: DataFrame, by_length: bool = False) -> DataFrame:
        """``start, end, step, direction``: the first step of each shortest path and where it goes; pairs without a step have no row."""
        return paths.first_directions(paths.distances_between(pairs, self._weighted(by_length), self.graph.nodes), self.graph.nodes, direction_ew_first)

    def compute_shortest_path(self, start: str, end: str) -> list[str]:
        return list(self.path_pairs(self._pair(start, end)).first().path)

    def get_node_coordinates(self, node_id: str) -> tuple[float, float] | None:
        r = graphs.node_coordinates(self.spark.createDataFrame([(node_id,)], "id string"), self.graph.nodes).first()
        return None if r.lat is None else (r.lat, r.lon)

    def get_path_length(self, path: list[str]) -> float:
        rows = self.spark.createDataFrame([(0, path)], "path_id int, path array<string>")
        return paths.path_lengths(rows, self.graph.nodes).first().metres

    def get_coarse_direction(self, a: tuple[float, float], b: tuple[float, float]) -> str:
        return self.spark.range(1).select(direction_ns_first(*map(F.lit, (*map(float, a), *map(float, b)))).alias("d")).first().d
