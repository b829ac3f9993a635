import pytest

ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en"),
    (1, "one two three four five six seven eight nine ten eleven twelve", "en"),  # a repeated row
    (2, None, None),
    (3, "", "en"),
    (None, "a text without an id, of more than ten words, all of them different ones here", None),
    (5, "tie tie tie tie tie tie tie tie tie tie tie tie", "de"),
    (5, "another text of an id that comes twice, with its own words in it, so to say", "de"),
    (6, "word " * 30_000 + "end", "en"),
    (7, " \n\t ", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and ids, and columns with clashing names."""
    names = ["id", "n", "start", "spans", "label", "score", "kept", "set_key", "class_id", "bytes", "content", "row", "changed", "frame", "h", "kept_id", "kept_hash", "kept_all", "_rule_w", "_rule_row", "_rule_stays", "own_id"]
    rows = [(*r, len(r[1] or ""), *[7] * len(names)) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"{n} int" for n in names))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
