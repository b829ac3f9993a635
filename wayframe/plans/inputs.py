"""Inputs of the queries, derived from the driver's tables by expressions that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: An instruction for each part; p is the part table.
INSTRUCTION = """concat(
 CASE WHEN p_partkey % 7 = 0 THEN 'Exactly ' ELSE '' END,
 CASE p_partkey % 5 WHEN 0 THEN '2-3 blocks ' WHEN 1 THEN '4 blocks ' WHEN 2 THEN '1.5 miles ' WHEN 3 THEN '3 4 streets ' ELSE '' END,
 CASE p_partkey % 4 WHEN 0 THEN 'north of ' WHEN 1 THEN 'Southeast ' WHEN 2 THEN 'west of ' ELSE 'between the eastern ' END,
 p_name,
 CASE WHEN p_partkey % 3 = 0 THEN ', past the grand hall' ELSE '' END,
 CASE WHEN p_partkey % 6 = 0 THEN ', past the mill' ELSE '' END,
 CASE WHEN p_partkey % 4 = 1 THEN concat(', near the ', p_name) ELSE '' END,
 CASE WHEN p_partkey % 5 = 3 THEN ', at the corner of 1st Ave and 2nd St' ELSE '' END,
 CASE WHEN p_partkey % 2 = 0 THEN ', then the second gate on the eastern side' ELSE '' END)"""
INSTRUCTIONS = f"SELECT CAST(p_partkey AS STRING) AS id, p_brand AS region, {INSTRUCTION} AS instruction, 40.7 + CAST(p_partkey % 100 AS DOUBLE) / 1000 AS target_lat, -73.9 - CAST(p_partkey % 90 AS DOUBLE) / 1000 AS target_lon FROM part"
#: Nodes; {0} and {1} are the places of the first and second number of a list.
NODES = "SELECT vec_id AS id, label, 40.7 + CAST(embedding[{0}] AS DOUBLE) * 0.1 AS lat, -73.9 + CAST(embedding[{1}] AS DOUBLE) * 0.1 AS lon, concat('n', CAST(vec_id AS STRING)) AS name FROM embeddings"
#: Directed edges between nodes of a label at distances 1, 3 and 7 in id order; raw: with some to unknown nodes.
EDGES = """SELECT src, dst, pos FROM (
 SELECT id AS src, lead(id, 1) OVER (PARTITION BY label ORDER BY id) AS dst, 0 AS pos FROM geo_nodes UNION ALL
 SELECT id AS src, lead(id, 3) OVER (PARTITION BY label ORDER BY id) AS dst, 1 AS pos FROM geo_nodes UNION ALL
 SELECT id AS src, lead(id, 7) OVER (PARTITION BY label ORDER BY id) AS dst, 2 AS pos FROM geo_nodes) AS e WHERE dst IS NOT NULL"""
RAW_EDGES = "SELECT src, dst, pos FROM geo_edges UNION ALL SELECT id AS src, -id - 1 AS dst, 9 AS pos FROM geo_nodes WHERE id % 50 = 0"
#: Pairs of nodes: in a label, across labels, to unknown ends, and between unknown ends.
PAIRS = """SELECT a.id AS start, b.id AS "end" FROM (SELECT label, min(id) AS id FROM geo_nodes GROUP BY label) AS a JOIN geo_nodes AS b ON b.label = a.label
 UNION ALL SELECT a.id, b.id FROM (SELECT label, min(id) AS id FROM geo_nodes GROUP BY label) AS a JOIN (SELECT label, max(id) AS id FROM geo_nodes GROUP BY label) AS b ON b.label = a.label + 1
 UNION ALL SELECT id, -id - 1 FROM geo_nodes UNION ALL SELECT -id - 1, -id - 1 FROM geo_nodes"""
SOURCES = "SELECT min(id) AS id FROM geo_nodes GROUP BY label"
#: Nodes with coordinates under several names, zeros and gaps.
RAW_NODES = """SELECT id, CASE id % 5 WHEN 0 THEN lat WHEN 1 THEN 0D END AS lat, CASE id % 5 WHEN 1 THEN lat WHEN 2 THEN 0D END AS latitude, CASE WHEN id % 5 IN (2, 3) THEN lat WHEN id % 10 = 4 THEN 0D END AS y,
 CASE id % 3 WHEN 0 THEN lon WHEN 1 THEN 0D END AS lon, CASE id % 3 WHEN 1 THEN lon END AS longitude, CASE id % 3 WHEN 2 THEN lon END AS x, CASE WHEN id % 6 <> 0 THEN name END AS name, label FROM geo_nodes"""
#: Edges from each node to those 1, 25 and 60 places on, with lengths, some of them missing.
ROADS = "SELECT a.id AS src, b.id AS dst, 0 AS pos, CASE WHEN a.id % 11 <> 0 THEN {length} END AS length FROM geo_nodes AS a JOIN geo_nodes AS b ON b.id = a.id + {step}"
ROADS = " UNION ALL ".join(ROADS.format(step=k, length=f"CAST(1000 + (a.id * 7919 + {k} * 104729) % 10007 AS DOUBLE) / 1000") for k in (1, 25, 60))
#: Places in the list of nodes from and to which one decision is asked.
PLACES = (0, 499)
#: Ends in a diagonal, in one point, and along one axis.
TIES = """SELECT * FROM (VALUES (CAST(-1 AS BIGINT), CAST(1 AS BIGINT), 0D, 0D, 1D, 1D), (-1, 2, 0D, 0D, -1D, -1D), (-1, 3, 5D, 5D, 5D, 5D), (-1, 4, 0D, 0D, 1D, -1D), (-1, 5, 1D, 1D, 1D, 2D), (-1, 6, 1D, 1D, 0D, 1D)) AS t(src, dst, lat1, lon1, lat2, lon2)"""


class Inputs:
    """Temporary views of one folder's tables and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **tables: DataFrame) -> DataFrame:
        """SQL over DataFrames named in it as {name}."""
        return self.spark.sql(text, **tables)

    @property
    def instructions(self) -> DataFrame:
        return self.sql(INSTRUCTIONS.replace("FROM part", "FROM {part}"), part=self.table("part"))

    @property
    def nodes(self) -> DataFrame:
        return self.sql(NODES.format(0, 1).replace("FROM embeddings", "FROM {embeddings}"), embeddings=self.table("embeddings"))

    @property
    def edges(self) -> DataFrame:
        return self.sql(EDGES.replace("geo_nodes", "{geo_nodes}"), geo_nodes=self.nodes)

    @property
    def raw_edges(self) -> DataFrame:
        return self.sql(RAW_EDGES.replace("geo_nodes", "{geo_nodes}").replace("geo_edges", "{geo_edges}"), geo_nodes=self.nodes, geo_edges=self.edges)

    @property
    def raw_nodes(self) -> DataFrame:
        return self.sql(RAW_NODES.replace("geo_nodes", "{geo_nodes}"), geo_nodes=self.nodes)

    @property
    def roads(self) -> DataFrame:
        return self.sql(ROADS.replace("geo_nodes", "{geo_nodes}"), geo_nodes=self.nodes)

    @property
    def pairs(self) -> DataFrame:
        return self.sql(PAIRS.replace('"end"', "`end`").replace("geo_nodes", "{geo_nodes}"), geo_nodes=self.nodes)

    @property
    def sources(self) -> DataFrame:
        return self.sql(SOURCES.replace("geo_nodes", "{geo_nodes}"), geo_nodes=self.nodes)


def _duck(text: str) -> str:
    """Spark's numbers like 0D as DuckDB writes them."""
    return re.sub(r"(-?\b\d+)D\b", r"CAST(\1 AS DOUBLE)", text)


DUCK_INPUTS = f"""instructions AS ({INSTRUCTIONS}), geo_nodes AS ({NODES.format(1, 2)}), geo_edges AS ({EDGES}), raw_edges AS ({RAW_EDGES}), pairs AS ({PAIRS}), sources AS ({SOURCES}), raw_nodes AS ({_duck(RAW_NODES)}), roads AS ({ROADS}), ties AS ({_duck(TIES)})"""
