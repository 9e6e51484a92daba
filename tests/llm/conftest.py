import random

import pytest

CLASHES = ("block", "bucket", "vector", "blob", "t", "w", "queue", "part", "ids", "spans", "held", "key", "text_key", "row_key", "band", "a", "b", "n", "gone", "hit")


def odd_rows(seed=3):
    """NULLs, empty and very long texts, ties, repeated rows, hot copies."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("aeinorstlé") for _ in range(draw.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(draw.choice(words) + draw.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))
    hot, passage = prose(150), prose(60)
    near = hot.split(" ")
    near[40] = "edited"
    rows = [(1, None, "s"), (2, "", "s"), (3, " \n\t ", None), (None, prose(80), "s"), (None, None, None), (4, prose(30000), "s0"),
            (5, "x" * 20000, "s0"), (6, hot, "s"), (6, hot, "s"), (7, " ".join(near), "s1"), (8, prose(70) + "\n" + passage + "\n" + prose(20), "s1"),
            (9, passage + " " + prose(90), "s2"), (9, "same id, other text " + prose(55), "s2"), (10, "one two three", "s2"), (11, "one two three", "s2")]
    rows += [(100 + i, hot, "s0") for i in range(12)] + [(200 + i, prose(draw.randint(1, 120)), f"s{i % 3}") for i in range(25)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([r + ("z",) * len(CLASHES) for r in odd_rows()], schema).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
