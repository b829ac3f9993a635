"""Spatial vocabulary as regular expressions."""

# Patterns, as the variants' texts depend on them.
CARDINAL = r"\b(north|south|east|west|northeast|northwest|southeast|southwest)\b"
ORDINAL_DIRECTION = r"\b(northern|southern|eastern|western)\b"
DISTANCE = r"\b(\d+(?:\.\d+)?)\s*(?:-\s*)?(\d+)?\s*(blocks?|meters?|feet|km|miles?|streets?)\b"
RELATIVE = r"\b(closer to|near|next to|between|past|across from|diagonal|around)\b"
PAST_LANDMARK = r",?\s*past\s+the\s+[\w\s-]+?(?=,|and|$)"
NEAR_LANDMARK = r",\s*near\s+the\s+[\w\s-]+?(?=,|and|$)"
INTERSECTION = r",?\s*at\s+the\s+corner\s+of\s+[^,]+?(?=,|and\s+(?:north|south|east|west)|$)"
BLOCK_COUNT = r"\b(\d+(?:\.\d+)?)\s*(?:-\s*)?(\d+)?\s*(blocks?|streets?)\b"
METRIC = r"\b\d+(?:\.\d+)?\s*(meters?|feet|km|miles?)\b"
EXACTLY = r"\bexactly\b"
ORDINAL_NUMBER = r"\b(first|second|third|fourth|fifth)\b"

# Names and expected effects of the strategies.
STRATEGIES = (
    ("Strategy 1: Spatial Relation Removal", "May fail to infer direction/distance; could guess randomly"),
    ("Strategy 2: Landmark Omission", "May lose precision; hallucinate missing landmarks"),
    ("Strategy 3: Distance/Precision Degradation", "May over/underestimate distance; overconfident guessing"),
)

#: Ignore case by Unicode rules, Unicode classes, and $ before a final \n only.
FLAGS = "(?idU)"
