"""Schemas, as DDL, of instruction tables, variants and graphs."""


INSTRUCTIONS = "id string, region string, instruction string, target_lat double, target_lon double"
VARIANTS = "instruction_id string, region string, original_instruction string, strategy_applied string, underspecified_instruction string, removed_information string, expected_impact string, ground_truth_lat double, ground_truth_lon double"
NODES = "id string, lat double, lon double, name string"
EDGES = "src string, dst string, pos int"
GRAPH_FILE = "nodes map<string,map<string,string>>, edges map<string,array<string>>"
