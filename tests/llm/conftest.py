import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, node string, size string, items int, shard string, score string, n int, __d int, __h int, __n int, __removed int, __pieces int, __text_hash int, __k0 int, __k1 int, removed int, hash int, id int, c0 int, text_hash int, n_sentences int, __text int"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["ab", "cd", "Ef", "gh", "ij", "klm"]) + str(rng.randint(0, 99)) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def hostile(spark):
    """Nulls, empty and blank texts, repeated rows, ties, long texts (one of some MB, one of a single word of 2 MB), columns with clashing names."""
    rng = random.Random(1)
    base = " ".join(sentence(rng, 12) for _ in range(6))
    texts = [(1, base), (1, base), (2, base), (3, base + " more"), (4, None), (4, None), (None, base), (None, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one two three"), (9, "!!! ???"), (10, "!!! ???"),
             (11, " ".join(sentence(rng, 14) for _ in range(1500))), (12, "naïve café ñandú Straße 你好 😀"), (13, "CC BY-NC all rights reserved"), (14, base.upper()), (15, " ".join(sentence(rng, 14) for _ in range(30000))), (16, "giant" * 400_000)]
    rows = [(i, t, None if i in (2, 5) else "en", None if i == 3 else "s", None, 7, "x", "y", 1, "z", "w", 2, *range(15)) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
