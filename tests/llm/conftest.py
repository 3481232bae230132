import random

import pytest

WORDS = [f"{a}{b}" for a in ("ra", "li", "mo", "te", "ka", "su", "ét", "or") for b in ("n", "ste", "vik", "lo", "m", "der", "qui", "zz", "pa")]


def prose(rng, n, lines=True):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS).capitalize() if rng.random() < 0.1 else rng.choice(WORDS))
        out.append("\n" if lines and rng.random() < 0.06 else " ")
    return "".join(out).strip()


def corpus():
    """(doc_id, text): prose with exact and near copies, shared passages, nulls, empty, tiny, wide and very long texts."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(60)]
    passage = prose(rng, 60, lines=False)
    texts += [texts[3], texts[3], texts[5]]
    for k in (8, 9, 10):
        words = texts[k].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    base = prose(rng, 150)
    for k in range(12):  # near copies that are linked in chains
        words = base.split(" ")
        for j in range(k):
            words[(7 * j) % len(words)] = f"edit{j}"
        texts.append(" ".join(words))
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 15), passage + "\n" + prose(rng, 30), passage]
    texts += [None, "", " \n\t ", "one", "two words", "über \U0001f600 中文 x", " a b", "ha " * 90, "x" * 3000, prose(rng, 6000), "A B C D E F", "a b c d e f", "tabs\tand\x0bfeeds\x0cend"]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame([(d, t, "l", 1.5) for d, t in rows], "doc_id long, text string, tokens string, __row double")
    return df.repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
