"""Rewriting strategies on the sample instructions and on edge cases."""

import pytest

from wayframe.api import InstructionDegrader
from wayframe.functions.text import degrade
from wayframe.operators import variants as V
from wayframe.sources import instructions
from wayframe.sources.instructions import read_instructions, sample_instructions, write_variants

# Expected variants of the sample: id, strategy, text, removed (terms of unordered clauses in text order).
EXPECTED = [
    ("manhattan_001", 1, "some distance from Central Park and some distance from the museum", "Cardinal directions: north, east; Distances: 2 blocks, 1 block"),
    ("manhattan_001", 3, "some blocks north of Central Park and some block east of the museum", "Exact block counts: 2, 1"),
    ("manhattan_002", 1, "from the library, near the fountain, near the Y-shaped intersection", "Cardinal directions: East; Relative terms: past, near"),
    ("manhattan_002", 2, "East of the library", "Intermediate 'past' landmarks: 1 removed; Secondary 'near' landmarks: 1 removed"),
    ("brooklyn_001", 1, "Exactly some distance on Atlantic Avenue", "Cardinal directions: south; Distances: 3 blocks"),
    ("brooklyn_001", 3, "some blocks south on Atlantic Avenue", "Exact block counts: 3; Precision marker: 'exactly'"),
    ("manhattan_003", 1, "near the post office and the park, near the park", "Relative terms: Between, closer to"),
    ("queens_001", 1, "At the corner of Queens Blvd and 42nd St, from the subway station", "Cardinal directions: north"),
    ("queens_001", 2, "north of the subway station", "Street intersections: 1 removed"),
    ("manhattan_004", 1, "some distance from Columbus Circle, from a police station", "Cardinal directions: north; Distances: 3-4 blocks"),
    ("manhattan_004", 3, "some blocks from Columbus Circle, north of a police station", "Exact block counts: 3-4"),
    ("manhattan_005", 1, "Walk on 8th Ave, at a parking entrance a block from a police station", "Cardinal directions: north"),
]
# Text, and the three rewrites (None: unchanged).
EDGES = [
    ("1.5-2.5 miles on", "1.5-some distance on", None, "1.5-some distance on"),
    ("3-4 km up", "some distance up", None, "3-some distance up"),
    ("3 4 blocks", "some distance", None, "some blocks"),
    ("5 BLOCKS", "some distance", None, "some BLOCKS"),
    ("past the Grand Hotel, left", "near the Grand Hotel, left", "and Hotel, left", None),
    ("past the St. Mark church, left", "near the St. Mark church, left", None, None),
    ("x, past the A, past the B", "x, near the A, near the B", "x", None),
    ("x, near the A, near the B, y", None, "x, y", None),
    ("repast the bank", None, "re", None),
    ("the first street, second", None, None, "the a street, a"),
    ("go exactly", None, None, None),
    ("a,, ,b , north, south, east, c", "a,,b,, c", "a,,b, north, south, east, c", None),
    ("Near the NORTHEAST gate", "near the gate", None, None),
    ("go north of it", "go from it", "go north of it", "go north of it"),
    ("past theé café past the café", "near theé café near the café", "past theé café", None),
    ("north\nof x", "from x", "north of x", "north of x"),
    ("3 north blocks up", "some distance up", None, None),
    ("north-eastern gate", "- gate", None, None),
    ("past the and bank, x", "near the and bank, x", "x", None),
    ("  , near the mill", "near the mill", "", ", near the mill"),
    ("", None, None, None),
]


def test_sample_variants(spark):
    rows = V.head(V.expand(sample_instructions(spark)), 100).collect()
    got = {(r.instruction_id, r.strategy_no): (r.underspecified_instruction, r.removed_information) for r in rows}
    assert got == {(i, k): (t, r) for i, k, t, r in EXPECTED}


def test_edges(spark):
    rows = degrade(spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(EDGES)] + [(99, None)], "k int, text string"), "text").collect()
    for r in rows:
        if r.k == 99:
            assert (r.t1_text, r.t1_removed, r.t3_removed) == (None, None, None)
            continue
        text, *want = EDGES[r.k]
        assert [r.t1_text, r.t2_text, r.t3_text] == [text if w is None else w for w in want], text
    by = {EDGES[r.k][0]: r for r in rows if r.k != 99}
    assert by["go exactly"].t3_removed == "Precision marker: 'exactly'"
    assert by["x, near the A, near the B, y"].t1_removed == "Relative terms: near"
    assert by[""].t1_removed is None


def test_report_and_sample(spark):
    made = V.expand(sample_instructions(spark))
    s = V.quality_summary(made).first()
    assert (s.n_variants, s.n_instructions, s.n_strategy_1, s.n_strategy_2, s.n_strategy_3) == (12, 7, 7, 2, 3)
    assert [(r.n, r.percent) for r in V.strategy_shares(made).collect()] == [(7, 58.3), (3, 25.0), (2, 16.7)]
    one, two = (sorted(r.id for r in V.sample_exactly(sample_instructions(spark), 3).collect()) for _ in range(2))
    assert one == two and len(set(one)) == 3
    assert V.sample_exactly(sample_instructions(spark), 100).count() == 7
    assert V.expand(sample_instructions(spark).limit(0)).count() == 0
    assert "Variants: 12" in V.report_lines(made)


def test_files(spark, tmp_path):
    with pytest.raises(ValueError):
        read_instructions(spark, "table.xml")
    path = tmp_path / "i.csv"
    path.write_text('id,region,instruction,target_lat,target_lon\na,R,"north of ""x"", past the mill",1.5,2.5\n')
    row = read_instructions(spark, str(path)).first()
    assert (row.instruction, row.target_lon) == ('north of "x", past the mill', 2.5)
    (tmp_path / "i.json").write_text('[{"id": "a", "region": "R", "instruction": "go east", "target_lat": 1, "target_lon": 2}]')
    assert read_instructions(spark, str(tmp_path / "i.json")).first().instruction == "go east"
    d = InstructionDegrader(spark)
    d.save(d.generate(), str(tmp_path / "out"), files=1)
    back = spark.read.options(header=True, quote='"', escape='"').csv(str(tmp_path / "out"))
    assert back.count() == 12 and back.columns[0] == "instruction_id"
    assert d.degrade_text("go up", 2) == {"underspecified": "go up", "removed": "None"}


def test_stream(spark, tmp_path):
    from wayframe.streaming.variants import run_once, stream_variants

    sample_instructions(spark).write.json(str(tmp_path / "in"))
    run_once(stream_variants(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def test_csv_files_have_a_bound(spark, tmp_path, monkeypatch):
    """One partition ends in several files, which hold all rows, line breaks and quotes within them."""
    monkeypatch.setattr(instructions, "CSV_ROWS", 4)
    rows = spark.createDataFrame([(f"{k:02}", "r", f'2 blocks "north"\nof, {k}', 1.0, 2.0) for k in range(10)], sample_instructions(spark).schema).coalesce(1)
    made = V.expand(rows)
    write_variants(made, str(tmp_path / "v.csv"))
    files = list((tmp_path / "v.csv").glob("part-*"))
    assert len(files) == -(-made.count() // 4) > 2
    assert sorted(map(tuple, instructions.read_variants(spark, str(tmp_path / "v.csv")).collect())) == sorted(map(tuple, made.drop("strategy_no").collect()))
