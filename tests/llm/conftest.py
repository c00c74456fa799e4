import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly box with huge liquor jugs and two bright vixens sing".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): nulls, empty and long texts, ties, exact and near copies, a hot group, a shared passage."""
    long, passage = prose(1, 9000), prose(2, 40)
    base = [prose(100 + i, 60 + i) for i in range(12)]
    near = [" ".join(w if k != 7 + i else "edit" for k, w in enumerate(base[0].split())) for i in range(6)]
    out = [
        (0, base[0], "en", "b"), (1, base[1], "en", "a"), (2, base[0], "en", "a"), (3, None, None, "a"), (4, "", "en", None), (5, " \t\n", "fr", None), (6, long, "en", "c"),
        (7, long + " tail", "en", "c"), (8, "***  123", None, "a"), (9, "One", "en", "b"), (10, "one", "en", "b"), (11, "one two three", "de", "b"), (12, "é" * 60, "fr", "a"),
        (13, "é" * 61, "fr", "a"), (None, "no id " + prose(3, 30), "en", "a"), (None, None, None, None), (14, "Under the MIT License.\nunder the mit license", "en", "d"),
        (15, "Apache License, Version 2.0; CC BY-NC 4.0, GPL-3.0-only " + prose(4, 20), "en", "d"), (1, base[1], "en", "a"), (16, "ab" * 200, "en", "d"), (17, "ab" * 40, "en", "d"),
    ]
    out += [(20 + i, t, "en", "a") for i, t in enumerate(near)]
    out += [(30 + i, f"{base[2 + i]} {passage} {base[3 + i]}", "en", "bc"[i % 2]) for i in range(8)]
    out += [(50 + i, base[11], "en", "a") for i in range(30)]
    out += [(90 + i, base[11].replace(" ", "  " if i else "\n"), "en", "a") for i in range(2)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names clash with those of results and helpers."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, rid string, n string, score string, length string, start string"
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z", "n", "s", "l", "t") for r in rows], schema).repartition(5)


@pytest.fixture(scope="session")
def none(spark, docs):
    return docs.limit(0)
