import random

import pytest

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, copy string, kept string, score string, n_words string, docs_2 string"
WORDS = "the house stands on a hill and the river runs below it while many birds sing in old trees near water every morning".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice("abcdefghij") * r.randint(0, 2)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, odd characters, columns named like new ones."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, None, "en", "b"), (5, "", None, "b"), (6, " \n\t ", "de", None), (7, prose(7, 60_000), "en", "a"),
        (None, base, "en", "a"), (None, None, None, None), (8, "two words", "en", "c"), (9, "TWO words", "en", "c"), (10, "naïve <|endoftext|> é 日本 🙂 \x00 x", "fr", "c"), (11, "12345 !!! 678", None, "c"), (12, "x" * 300_000, "en", "a"),
        *[(100 + i, prose(100 + i, 90), ("en", "de")[i % 2], "abc"[i % 3]) for i in range(12)],
    ]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "c", "k", "s", "w", "z") for i, t, lang, s in rows], DDL)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
