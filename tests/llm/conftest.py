import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, shard int, kept boolean, start long, license string"
SYLLABLES = "an be cor du el fi ga ho in ka lo me no or pa qui ra sol te un ver wi".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def awkward_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, copies, near copies and shared passages."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    passage = prose(rng, 70)
    base = prose(rng, 200)
    near = base.split(" ")
    near[120] = "changed"
    texts = [None, "", "  \t\n ", "one", "one", "two words", "a b c d", "a b c d e", base, base.replace(" ", "\n", 7), " ".join(near), base + " tail", long,
             long[:50_000] + " and " + long[50_000:], prose(rng, 90) + "\n" + passage + "\n" + prose(rng, 40), passage, "x " + passage + " y\n\nline\nline\nline",
             "Füße, über die Straße! " * 30, "\x1c\x85 odd \x1d spaces \x0b\x0c here", "日本語 の 文章 " * 40, "🎉 emoji ## $$ || << & " * 20,
             "THE END!! THE END!! THE END!! " * 30, "Licensed under CC BY-NC 4.0. " + prose(rng, 60), "All rights reserved", prose(rng, 55) + " <|endoftext|> it's 12345 a_b"]
    rows = [(i, t, "en" if i % 3 else None, [None, "", "a", "b", "é", "z"][i % 6], None, i, 0.5, 3, False, 9, "x") for i, t in enumerate(texts)]
    rows += [rows[8]] * 3 + [(None, base, None, "a", 1, None, None, None, None, None, None)] * 2 + [(None, None, None, None, *[None] * 7)]
    rows += [(100 + i, prose(rng, rng.randint(20, 120)), "fr", "a", 5, 1, 1.0, 1, True, 1, None) for i in range(30)]
    rows += [(200 + i, passage + " " + prose(rng, 30), "fr", "hot", 5, 1, 1.0, 1, True, 1, None) for i in range(20)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
