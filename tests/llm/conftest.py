import random

import pytest

SYLLABLES = "ka lo mi ne ru ta ve zo shi pra gle dun".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


@pytest.fixture(scope="session")
def make():
    return prose


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, long and repeated texts, null ids, and columns named as the operators name theirs."""
    rng = random.Random(5)
    same = prose(rng, 80)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, same), (4, same), (5, same), (None, same), (None, prose(rng, 60)),
            (6, prose(rng, 40_000)), (7, "x" * 200_000), (8, "é\U0001f600 " * 30), (9, "a\x00b c"), (10, "word " * 70)]
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, 3, 4, 5, "r", "k") for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, tkey int, text_hash int, "
                                       "fp int, row int, kept_id string, g string")
