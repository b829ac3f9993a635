"""The queries as SQL for DuckDB. Plans are written anew here; patterns, names and sample rows, which are fixed values, are those of the package, and tests hold them against expected texts."""

from __future__ import annotations

from ..functions import patterns as P
from ..sources.graphs import SAMPLE_LINKS, SAMPLE_NODES
from ..sources.instructions import SAMPLE
from .inputs import DUCK_INPUTS, PLACES

WITH = f"WITH RECURSIVE {DUCK_INPUTS}"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _all(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({text}, {_q(pattern)}, {group}, 'i')"


def _sub(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {_q(pattern)}, {_q(by)}, 'gi')"


def _ranges(text: str, pattern: str, unit: bool) -> str:
    part = lambda k: f"coalesce(regexp_extract(m, {_q(pattern)}, {k}, 'i'), '')"
    return f"list_transform({_all(text, pattern, 0)}, lambda m: {part(1)} || CASE WHEN {part(2)} <> '' THEN '-' || {part(2)} ELSE '' END" + (f" || ' ' || {part(3)}" if unit else "") + ")"


def _terms(values: str) -> str:
    return f"array_to_string(list_sort({values}), '|')"


def _spaces(t: str) -> str:
    return f"trim({_sub(t, r'\s+', ' ')})"


def _commas(t: str) -> str:
    return _sub(_sub(_sub(_spaces(t), r"\s+,", ","), r",\s*,", ","), r"^\s*,\s*", "")


def _full(t: str) -> str:
    return _sub(_commas(t), r",\s*$", "")


def _mark(text: str, ends: str) -> str:
    """chr(1) before each place where a lookahead would hold, and at the end."""
    return f"(regexp_replace({text}, '({ends})', chr(1) || '\\1', 'gi') || chr(1))"


def _unmark(text: str) -> str:
    return f"replace({text}, chr(1), '')"


# Lookaheads as consumed marks: inner characters may be parted by marks, matches end at one.
_PAST, _NEAR = (head + r"\x01?\s*" + word + r"\s+the\s+\x01?[\w\s-]\x01?[\w\s-]*?\x01" for head, word in ((r"\x01?,?", "past"), (r"\x01?,", "near")))
_CORNER = r"\x01?,?\s*at\s+the\s+corner\s+of\s+[^,\x01]+?\x01"
_CORNER_ENDS = r",|and\s+(?:north|south|east|west)"

T1 = f"""a1 AS (SELECT *, instruction AS a0, {_sub(_sub('instruction', P.CARDINAL + r'\s+of\b', 'from'), P.CARDINAL, '')} AS a1 FROM instructions),
a2 AS (SELECT *, {_sub('a1', P.ORDINAL_DIRECTION, '')} AS a2 FROM a1), a3 AS (SELECT *, {_sub('a2', P.DISTANCE, 'some distance')} AS a3 FROM a2),
t1 AS (SELECT *, {_commas(_sub('a3', P.RELATIVE, 'near'))} AS text, {_all('a0', P.CARDINAL)} AS c, {_all('a1', P.ORDINAL_DIRECTION)} AS o, {_ranges('a2', P.DISTANCE, True)} AS d, {_all('a3', P.RELATIVE)} AS r FROM a3),
t1r AS (SELECT id, region, instruction, target_lat, target_lon, text, nullif(concat_ws('; ',
 CASE WHEN len(c) > 0 THEN 'Cardinal directions: ' || array_to_string(list_sort(list_distinct(c)), ', ') END, CASE WHEN len(o) > 0 THEN 'Ordinal directions: ' || array_to_string(list_sort(list_distinct(o)), ', ') END,
 CASE WHEN len(d) > 0 THEN 'Distances: ' || array_to_string(list_sort(d), ', ') END, CASE WHEN len(r) > 0 THEN 'Relative terms: ' || array_to_string(list_sort(list_distinct(r)), ', ') END), '') AS removed FROM t1)"""
T2 = f"""b1 AS (SELECT *, {_mark('instruction', ',|and')} AS m0 FROM instructions), b2 AS (SELECT *, {_unmark(_sub('m0', _PAST, ''))} AS b1, len({_all('m0', _PAST, 0)}) AS n1 FROM b1),
b3 AS (SELECT *, {_mark('b1', ',|and')} AS m1 FROM b2), b4 AS (SELECT *, {_unmark(_sub('m1', _NEAR, ''))} AS b2, len({_all('m1', _NEAR, 0)}) AS n2 FROM b3),
b5 AS (SELECT *, {_mark('b2', _CORNER_ENDS)} AS m2 FROM b4), t2 AS (SELECT *, {_full(_unmark(_sub('m2', _CORNER, '')))} AS text, len({_all('m2', _CORNER, 0)}) AS n3 FROM b5),
t2r AS (SELECT id, region, instruction, target_lat, target_lon, text, nullif(concat_ws('; ', CASE WHEN n1 > 0 THEN 'Intermediate ''past'' landmarks: ' || n1 || ' removed' END,
 CASE WHEN n2 > 0 THEN 'Secondary ''near'' landmarks: ' || n2 || ' removed' END, CASE WHEN n3 > 0 THEN 'Street intersections: ' || n3 || ' removed' END), '') AS removed FROM t2)"""
T3 = f"""c1 AS (SELECT *, {_sub('instruction', P.BLOCK_COUNT, 'some \\3')} AS c1 FROM instructions), c2 AS (SELECT *, {_sub('c1', P.METRIC, 'some distance')} AS c2 FROM c1),
c3 AS (SELECT *, {_sub('c2', P.EXACTLY + r'\s+', '')} AS c3 FROM c2), t3 AS (SELECT *, {_spaces(_sub('c3', P.ORDINAL_NUMBER, 'a'))} AS text, {_ranges('instruction', P.BLOCK_COUNT, False)} AS b, len({_all('c1', P.METRIC, 0)}) AS n, {_all('c3', P.ORDINAL_NUMBER)} AS o FROM c3),
t3r AS (SELECT id, region, instruction, target_lat, target_lon, text, nullif(concat_ws('; ', CASE WHEN len(b) > 0 THEN 'Exact block counts: ' || array_to_string(list_sort(b), ', ') END, CASE WHEN n > 0 THEN 'Exact distances: ' || n || ' removed' END,
 CASE WHEN regexp_matches(c2, {_q(P.EXACTLY)}, 'i') THEN 'Precision marker: ''exactly''' END, CASE WHEN len(o) > 0 THEN 'Ordinal positions: ' || array_to_string(list_sort(o), ', ') END), '') AS removed FROM t3)"""
_VARIANTS = f"{T1}, {T2}, {T3}, variants AS (" + " UNION ALL ".join(
    f"SELECT {k} AS strategy_no, id AS instruction_id, region, instruction AS original_instruction, {_q(name)} AS strategy_applied, text AS underspecified_instruction, removed AS removed_information, {_q(impact)} AS expected_impact, target_lat AS ground_truth_lat, target_lon AS ground_truth_lon FROM t{k}r WHERE removed IS NOT NULL"
    for k, (name, impact) in enumerate(P.STRATEGIES, 1)
) + ")"

_X = "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)"
_METRES = f"6371000.0 * 2 * atan2(sqrt({_X}), sqrt(greatest(0.0, 1 - ({_X}))))"
_ENDS = "ends AS (SELECT e.src, e.dst, e.pos, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM geo_edges AS e JOIN geo_nodes AS a ON a.id = e.src JOIN geo_nodes AS b ON b.id = e.dst)"
_A = "CASE WHEN abs(lat2 - lat1) >= abs(lon2 - lon1) THEN CASE WHEN lat2 > lat1 THEN 'N' ELSE 'S' END ELSE CASE WHEN lon2 > lon1 THEN 'E' ELSE 'W' END END"
_B = "CASE WHEN abs(lat2 - lat1) > abs(lon2 - lon1) THEN CASE WHEN lat2 > lat1 THEN 'N' ELSE 'S' END ELSE CASE WHEN lon2 > lon1 THEN 'E' ELSE 'W' END END"


def _paths(weight: str) -> str:
    return f"""{_ENDS}, weights AS MATERIALIZED (SELECT src, dst, min({weight}) AS w FROM (SELECT src, dst, {_METRES} AS w FROM ends) AS x GROUP BY src, dst),
{_best("weights", "sources")}"""


def _best(weights: str, sources: str) -> str:
    return f"""best(source, id, d, path) USING KEY (source, id) AS (SELECT id, id, CAST(0 AS DOUBLE), [id] FROM {sources} UNION
 SELECT t.source, e.dst, min(t.d + e.w), arg_min(list_append(t.path, e.dst), t.d + e.w) FROM best AS t JOIN {weights} AS e ON e.src = t.id LEFT JOIN recurring.best AS r ON r.source = t.source AND r.id = e.dst
 WHERE r.d IS NULL OR t.d + e.w < r.d GROUP BY t.source, e.dst)"""


_REACH = "reach(s, id) AS (SELECT DISTINCT start, start FROM pairs WHERE start IN (SELECT id FROM geo_nodes) UNION SELECT r.s, e.dst FROM reach AS r JOIN geo_edges AS e ON e.src = r.id)"
_UNTIDY = "(SELECT id, concat('  , ', instruction, ' ,, ' || chr(10) || ' and ,x ,') AS t FROM instructions)"



def _rows(rows: list[tuple], names: str) -> str:
    """A table of constants."""
    value = lambda v: _q(v) if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) AS t({names}))"


_SAMPLE = f"SELECT * FROM {_rows(SAMPLE, 'id, region, instruction, target_lat, target_lon')}"
_SAMPLE_EDGES = f"SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY k) - 1 AS INTEGER) AS pos FROM (SELECT src, dst, k FROM {_rows([(k, *x) for k, x in enumerate(SAMPLE_LINKS)], 'k, src, dst')} UNION ALL SELECT dst, src, k FROM {_rows([(k, *x) for k, x in enumerate(SAMPLE_LINKS)], 'k, src, dst')})"
_SAMPLE_NODES = f"SELECT * FROM {_rows(SAMPLE_NODES, 'id, lat, lon, name')}"
_INSTRUCTIONS = f"{WITH} SELECT id, region, instruction, target_lat, target_lon FROM instructions"
_SAMPLED = "SELECT id FROM instructions ORDER BY md5('42:' || id), id LIMIT 100"
_VALID = "valid AS (SELECT id FROM (SELECT id, coalesce(nullif(lat, 0), nullif(latitude, 0), y) AS lat, coalesce(nullif(lon, 0), nullif(longitude, 0), x) AS lon FROM raw_nodes) AS n WHERE lat IS NOT NULL AND lon IS NOT NULL)"
_TEXTS = "CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst"
_NAVIGATION = f"""weights AS MATERIALIZED (SELECT src, dst, min(coalesce(length, 1)) AS w FROM roads GROUP BY src, dst), starts AS (SELECT id FROM geo_nodes WHERE id = {PLACES[0]}), {_best("weights", "starts")}"""

ORACLE_SQL: dict[str, str] = {
    "instructions_sample": _SAMPLE,
    "instructions_json": _SAMPLE,
    "instructions_jsonl": _INSTRUCTIONS,
    "instructions_csv": _INSTRUCTIONS,
    "variants_csv": f"{WITH}, {_VARIANTS} SELECT * EXCLUDE (strategy_no) FROM variants",
    "dataset_driver": f"{WITH}, {_VARIANTS} SELECT * EXCLUDE (strategy_no) FROM variants WHERE instruction_id IN ({_SAMPLED})",
    "sample_exact_n": f"{WITH} SELECT id, instruction FROM instructions WHERE id IN ({_SAMPLED})",
    "sample_graph_nodes": _SAMPLE_NODES,
    "sample_graph_edges": _SAMPLE_EDGES,
    "graph_json_nodes": _SAMPLE_NODES,
    "graph_json_edges": _SAMPLE_EDGES,
    "graph_tables_edges": f"{WITH}, {_VALID} SELECT {_TEXTS}, pos FROM raw_edges WHERE src IN (SELECT id FROM valid) AND dst IN (SELECT id FROM valid)",
    "graph_tables_stats": f"{WITH}, {_VALID} SELECT (SELECT count(*) FROM valid) AS n_nodes, count(*) FILTER (dst IN (SELECT id FROM valid)) AS n_edges, count(*) FILTER (dst NOT IN (SELECT id FROM valid)) AS n_skipped FROM raw_edges WHERE src IN (SELECT id FROM valid)",
    "graph_tables_read": f"{WITH}, {_VALID} SELECT {_TEXTS}, length FROM roads WHERE src IN (SELECT id FROM valid) AND dst IN (SELECT id FROM valid)",
    "unsupported_formats": "SELECT * FROM (VALUES ('graph', 'ValueError'), ('instructions', 'ValueError')) AS t(what, outcome)",
    "positional_pick": f"{WITH} SELECT id AS pos, id, name FROM geo_nodes WHERE id IN {PLACES}",
    "navigation_decision": f"""{WITH}, {_NAVIGATION} SELECT CAST(b.source AS VARCHAR) AS start, CAST(b.id AS VARCHAR) AS "end", CAST(b.path[2] AS VARCHAR) AS step, direction FROM best AS b JOIN (SELECT s.id AS s, t.id AS t, {_B} AS direction FROM (SELECT s.id, s.lat AS lat1, s.lon AS lon1 FROM geo_nodes AS s) AS s JOIN roads AS e ON e.src = s.id JOIN (SELECT t.id, t.lat AS lat2, t.lon AS lon2 FROM geo_nodes AS t) AS t ON t.id = e.dst) AS d ON d.s = b.source AND d.t = b.path[2] WHERE b.id = {PLACES[1]}""",
    "cardinal_terms": f"{WITH} SELECT id, {_terms(_all('instruction', P.CARDINAL))} AS terms FROM instructions",
    "ordinal_dir_terms": f"{WITH} SELECT id, {_terms(_all('instruction', P.ORDINAL_DIRECTION))} AS terms FROM instructions",
    "distance_terms": f"{WITH} SELECT id, {_terms(_ranges('instruction', P.DISTANCE, True))} AS terms FROM instructions",
    "relative_terms": f"{WITH} SELECT id, {_terms(_all('instruction', P.RELATIVE))} AS terms FROM instructions",
    "prose_cardinal_docs": f"SELECT doc_id, {_terms(_all('text', P.CARDINAL))} AS terms FROM documents WHERE regexp_matches(text, {_q(P.CARDINAL)}, 'i')",
    "cleanup_light": f"{WITH} SELECT id, {_spaces('t')} AS text FROM {_UNTIDY}",
    "cleanup_commas": f"{WITH} SELECT id, {_commas('t')} AS text FROM {_UNTIDY}",
    "cleanup_full": f"{WITH} SELECT id, {_full('t')} AS text FROM {_UNTIDY}",
    **{f"t{k}_text": f"{WITH}, {t} SELECT id, text FROM t{k}r" for k, t in ((1, T1), (2, T2), (3, T3))},
    **{f"t{k}_removed": f"{WITH}, {t} SELECT id, removed FROM t{k}r" for k, t in ((1, T1), (2, T2), (3, T3))},
    "all_variants": f"{WITH}, {_VARIANTS} SELECT * EXCLUDE (strategy_no) FROM variants",
    "variant_strategy_share": f"{WITH}, {_VARIANTS} SELECT strategy_applied, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM variants), 1) AS percent FROM variants GROUP BY strategy_applied",
    "variant_distinct": f"{WITH}, {_VARIANTS} SELECT count(DISTINCT instruction_id) AS n_instructions FROM variants",
    "variant_head3": f"{WITH}, {_VARIANTS} SELECT instruction_id, strategy_applied, underspecified_instruction FROM variants ORDER BY instruction_id, strategy_no LIMIT 3",
    "quality_summary": f"{WITH}, {_VARIANTS} SELECT count(*) AS n_variants, count(DISTINCT instruction_id) AS n_instructions, count(*) FILTER (strategy_no = 1) AS n_strategy_1, count(*) FILTER (strategy_no = 2) AS n_strategy_2, count(*) FILTER (strategy_no = 3) AS n_strategy_3 FROM variants",
    "node_normalise": f"{WITH}, n AS (SELECT CAST(id AS VARCHAR) AS id, coalesce(nullif(lat, 0), nullif(latitude, 0), y) AS lat, coalesce(nullif(lon, 0), nullif(longitude, 0), x) AS lon, name, label FROM raw_nodes) SELECT * FROM n WHERE lat IS NOT NULL AND lon IS NOT NULL",
    "edges_valid": f"{WITH} SELECT src, dst, pos FROM raw_edges WHERE dst IN (SELECT id FROM geo_nodes)",
    "edges_dangling": f"{WITH} SELECT src, dst, pos FROM raw_edges WHERE dst NOT IN (SELECT id FROM geo_nodes)",
    "graph_stats": f"{WITH} SELECT (SELECT count(*) FROM geo_nodes) AS n_nodes, count(*) FILTER (dst IN (SELECT id FROM geo_nodes)) AS n_edges, count(*) FILTER (dst NOT IN (SELECT id FROM geo_nodes)) AS n_removed FROM raw_edges",
    "node_lookup": f"{WITH}, i AS (SELECT id FROM geo_nodes UNION ALL SELECT -id - 1 FROM geo_nodes) SELECT i.id, n.lat, n.lon FROM i LEFT JOIN geo_nodes AS n ON n.id = i.id",
    "edge_haversine": f"{WITH}, {_ENDS} SELECT src, dst, pos, round({_METRES}, 3) AS metres FROM ends",
    "direction_axis_a": f"{WITH}, {_ENDS} SELECT src, dst, {_A} AS direction FROM (SELECT * EXCLUDE (pos) FROM ends UNION ALL SELECT * FROM ties) AS x",
    "direction_axis_b": f"{WITH}, {_ENDS} SELECT src, dst, {_B} AS direction FROM (SELECT * EXCLUDE (pos) FROM ends UNION ALL SELECT * FROM ties) AS x",
    "neighbors_of": f"{WITH} SELECT src AS id, dst, pos FROM geo_edges",
    "edges_symmetric": f"{WITH} SELECT src, dst FROM geo_edges UNION ALL SELECT dst, src FROM geo_edges",
    "first_neighbor": f"{WITH} SELECT src, arg_min(dst, pos) AS dst FROM geo_edges GROUP BY src",
    "reachability_batch": f"""{WITH}, {_REACH} SELECT start, "end", (start IN (SELECT id FROM geo_nodes) AND "end" IN (SELECT id FROM geo_nodes) AND (start, "end") IN (SELECT s, id FROM reach)) AS reachable FROM pairs""",
    "shortest_distance": f"{WITH}, {_paths('w')} SELECT source, id, round(d, 3) AS dist FROM best",
    "shortest_distance_length": f"{WITH}, {_paths('coalesce(CASE WHEN src % 11 <> 0 THEN round(w, 0) END, 1)')} SELECT source, id, round(d, 3) AS dist FROM best",
    "shortest_path_nodes": f"{WITH}, {_paths('w')} SELECT source, id, array_to_string(path, '>') AS path FROM best",
    "shortest_path_pairs": f"""{WITH}, {_paths('w')} SELECT p.start, p."end", CAST(coalesce(len(b.path), CASE WHEN n.id IS NOT NULL THEN 1 END, 0) AS BIGINT) AS n_nodes, (b.path IS NOT NULL OR n.id IS NOT NULL) AS found
 FROM (SELECT DISTINCT start, "end" FROM pairs) AS p LEFT JOIN best AS b ON b.source = p.start AND b.id = p."end" LEFT JOIN geo_nodes AS n ON n.id = p.start AND p.start = p."end" """,
    "path_length": f"""{WITH}, lists AS (SELECT id AS path_id, CASE WHEN id % 4 = 1 THEN [id] ELSE [id, id + 3, -1, id + 7, id + 8] END AS path FROM geo_nodes), places AS (SELECT path_id, unnest(path) AS id, generate_subscripts(path, 1) AS k FROM lists),
 found AS (SELECT p.path_id, p.k, n.lat AS lat1, n.lon AS lon1, lead(n.lat) OVER w AS lat2, lead(n.lon) OVER w AS lon2 FROM places AS p LEFT JOIN geo_nodes AS n ON n.id = p.id WINDOW w AS (PARTITION BY p.path_id ORDER BY p.k)) SELECT path_id, round(coalesce(sum({_METRES}), 0), 3) AS metres FROM found GROUP BY path_id""",
    "first_step_direction": f"""{WITH}, {_paths('w')}, steps AS (SELECT b.source AS start, b.id AS "end", b.path[2] AS step, s.lat AS lat1, s.lon AS lon1, t.lat AS lat2, t.lon AS lon2 FROM best AS b JOIN geo_nodes AS s ON s.id = b.source JOIN geo_nodes AS t ON t.id = b.path[2] WHERE len(b.path) > 1) SELECT start, "end", step, {_B} AS direction FROM steps""",
}
