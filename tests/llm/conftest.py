import random

import pytest


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{'.' * (r.random() < 0.1)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Nulls, empty and very long texts, ties, exact and near copies, shared passages, odd bytes, clashing extra columns."""
    shared, lines = prose(1, 60), [prose(k, 120) for k in range(10, 22)]
    near = lines[0].split()
    near[50] = "changed"
    texts = [*lines, lines[0], lines[0], " ".join(near), prose(30, 40) + " " + shared + " " + prose(31, 40), shared + " " + prose(32, 50), prose(33, 30) + " " + shared, "", None, "one", "two words", "   \n\t ", "the " * 900, prose(40, 9000), "ÀÉ über ńaïve 日本語 <|endoftext|> don't we'll 're　x\x1cy\u0085z", "A b C d E f G", "a b c d e f g", shared]
    rows = [(k * 7 % 101 + (k // 101) * 1000, t, "en", "src0", 0 if t is None else len(t), -1.0, 5, "clash") for k, t in enumerate(texts)]
    rows.append((None, "no id " * 30, "en", None, 3, None, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, anchor int, place string")


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus.where("doc_id = -5")
