"""Small documents for the operators' tests."""

import random

DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
# names that operators use for their own columns, as extra columns of an input
CLASHING = ("node", "tokens", "path", "size", "weight", "label", "kept", "score", "predicted", "piece", "length", "ids",
            "n_links", "class_id", "held_out", "probability", "payload", "refers_to", "role", "formatted", "_draw",
            "_rank", "_key", "_i", "_size", "cluster", "unit", "bucket", "first_id", "_id", "_text", "links", "root")


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


def words(rng: random.Random, n: int, vocabulary: int = 5000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edge_rows() -> list[tuple]:
    """Null id and text, empty, blank, very long, symbols, repeated rows."""
    rng = random.Random(4)
    long = " ".join(words(rng, 60_000))
    rows = [(1, None, "en", None, None), (None, "some words without an id", None, None, 5), (2, "", "en", "s", 0),
            (3, " \n\t ", "en", "s", 4), (4, long, "en", "s", len(long)), (5, "a b", "fr", "s", 3),
            (6, "漢字 \u2581 \u0000 <s> </turn> \\### 😀", "zh", "s", 9)]
    return rows + [(5, "a b", "fr", "s", 3)]
