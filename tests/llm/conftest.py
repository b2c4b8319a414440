import random

import pytest

HOSTILE = [
    None, "", " ", "\n\n", "\t \x0b\n", "one", "One two", "a b c", "a\nb\na\n\nb", "é ü x́ H̱", "x " * 40, "a b c d e f g h\n" * 9, "\x85abc\x1c d",
    "!!!! #### $$$$", "<|endoftext|> <s> <unk>", "The quick brown fox jumps over the lazy dog. " * 3, "word" * 3000, "naïve café 日本語 テキスト 😀😀", "A" * 10, "pipe | list | of | junk | words | here |\n" * 8,
]


def documents(seed: int = 5, n: int = 60) -> list[tuple]:
    """Hostile texts, random prose with exact and near copies, repeated rows, a null id."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(120)]
    texts = list(HOSTILE)
    for _ in range(n):
        lines = [" ".join(rng.choices(words, k=rng.randint(3, 30))).capitalize() + "." for _ in range(rng.randint(1, 6))]
        texts.append("\n".join(lines))
    base = " ".join(rng.choices(words, k=200))
    for i in range(12):
        w = base.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "changed%d" % rng.randrange(99)
        texts.append(" ".join(w))
    texts += texts[25:35]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, rows[30], rows[30], (None, "no id here but some words"), (None, None)]


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Columns whose names clash with the operators' own."""
    data = [(i, t, "en", "src", None if t is None else len(t), 1, "x", 2.0, b"z") for i, t in rows]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, node long, key string, part double, data binary")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
