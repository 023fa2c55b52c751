"""A hard little corpus: nulls, empty and long texts, repeated rows, ties, and columns whose names clash with the operators' own."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, h long, score double, size long"


def hard_rows():
    rng = random.Random(5)
    line = "The same long line that many documents share, word for word."
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "ﬁn", "日本", "it's", "<|endoftext|>", "▁"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(120)
    texts = [None, "", " ", "\n\n", "one", "two words", base, base, base.replace("w1 ", "zz ", 1), base + " tail", line, f"{line}\n{prose(30)}\n  {line.upper()}  ", f"{prose(20)}\n{line}", "Tab\tseparated\x0bvertical\x0cfeed\r\nwindows", prose(4000), "a  b   c ", "x" * 3000, "!!" * 50]
    texts += [prose(rng.randint(5, 60)) for _ in range(20)] + [base[:300] + prose(10) for _ in range(4)]
    rows = [(i if i != 20 else None, t, "en", [None, "s1", "s2", "s3"][i % 4], len(t or ""), "k", 1, 2, 0.5, 3) for i, t in enumerate(texts)]
    return rows + [rows[6], rows[14]]  # repeated rows


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
