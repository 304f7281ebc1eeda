import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "tu", "Ré", "ße") for b in ("", "r", "st", "ndo", "x,", "Ü.")]


def passage(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(n))


def corpus() -> list[tuple[int | None, str | None]]:
    """Texts with copies, near copies, shared passages, nulls, empties, blanks, a very long one, repeated rows and a null id."""
    rng = random.Random(3)
    rows: list[tuple[int | None, str | None]] = []
    base = [passage(rng, rng.choice([1, 2, 5, 19, 20, 60, 150, 400])) for _ in range(30)]
    shared = passage(rng, 70)
    for i, text in enumerate(base):
        rows.append((i, text))
        if i % 3 == 0:
            rows.append((100 + i, text))
        if i % 4 == 0:
            words = text.split(" ")
            words[len(words) // 2] = "zz"
            rows.append((200 + i, " ".join(words)))
        if i % 5 == 0:
            rows.append((300 + i, text[: len(text) // 3] + shared + text[len(text) // 3 :]))
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "One"), (405, "ab " * 900), (406, "x" * 3000), (407, passage(rng, 6000)), (408, None)]
    rows += [(409, base[6]), (409, base[6]), (None, base[7]), (410, "   á \x1c word's 'll ＡＢ ﬁ İ ΑΣ 12 <|endoftext|>x")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    clash = [(i, t, "key", "h", 1, 2) for i, t in rows]
    return spark.createDataFrame(clash, "doc_id long, text string, key string, h string, n int, found int").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string")
