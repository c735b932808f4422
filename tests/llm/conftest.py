import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `set` string, uid string, key string, spans string, place string"


def words(rng: random.Random, n: int, stem: str = "") -> list[str]:
    return [stem + "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def corpus(seed: int = 1) -> list[tuple]:
    """Copies, near copies, shared passages, repeats, empty and odd texts, null ids, repeated rows, one long text."""
    rng = random.Random(seed)
    texts: list[str | None] = [" ".join(words(rng, rng.randint(1, 120))) for _ in range(40)]
    passage = " ".join(words(rng, 60))
    base = words(rng, 100)
    texts += [f"{' '.join(words(rng, 30))} {passage} {' '.join(words(rng, 30))}" for _ in range(6)]
    for k in range(12):  # near copies around the threshold
        near = list(base)
        for j in rng.sample(range(100), k % 5):
            near[j] = f"new{k}x{j}"
        texts.append(" ".join(near))
    texts += [" ".join(base), " ".join(base).upper(), "be " * 150, "aaaa" * 60, "line one is here\n" * 20]
    texts += [None, "", "   \n ", "12 34 !!", "été à la plage\tavec NOUS", "one two", "ONE  two", "😀 " * 40, " ".join(words(rng, 3000))]
    rows = [(k * 3 % 97, t, ["en", "fr", None][k % 3], ["a", "a", "b", None][k % 4], None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here at all", "en", "a", 17), (None, None, None, None, None)]
    return [(*r, "x", "y", "z", "s", "p") for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
