import random

import pytest

WORDS = [a + b for a in "ba be bi bo bu da de di do du ka ke ki ko ku".split() for b in "la le li lo lu ma me mi mo mu".split()]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".\n", "é"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, blanks, one long one and nulls."""
    passage = prose(1, 60)
    base = [prose(i, 40 + 7 * i % 200) for i in range(2, 30)]
    out = list(base)
    out += [base[0], base[0].upper(), base[1], base[1]]  # copies, some in another case
    near = prose(99, 150).split(" ")
    for i in range(12):  # a chain and a star of near copies
        out.append(" ".join([*near[:i * 3], f"edit{i}", *near[i * 3:]]))
    out += [prose(40 + i, 30) + " " + passage + " " + prose(60 + i, 30) for i in range(8)]
    out += [None, "", " ", "\n\t", "one", "One", "one two three", "a" * 300, "a" * 300, prose(7, 20_000), None, ""]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with a clashing extra column, shuffled ids and a repeated row."""
    rows = [(i * 7 % 1009, t, f"s{i % 3}" if i % 5 else None, float(i), "x") for i, t in enumerate(texts)]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, `row` string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, score double, `row` string")
