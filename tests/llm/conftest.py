import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_documents(seed: int = 3) -> list[tuple]:
    """Small corpus with copies, near copies, shared passages, runs, odd spaces, nulls and empties."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéßçn") for _ in range(r.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, other = prose(60), prose(45)
    base = [prose(r.randint(1, 160)) for _ in range(40)]
    texts = list(base)
    texts += [base[3]] * 6 + [base[4].upper()]
    for _ in range(25):  # near copies of one text
        w = base[5].split() + prose(80).split()[:0]
        for _ in range(2):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    texts += [f"{prose(r.randint(0, 30))} {passage} {prose(r.randint(0, 30))}" for _ in range(8)]
    texts += [f"{prose(9)}\n{other}\t{other}\r\n{prose(3)}"]
    texts += ["ab " * 90, "ab " * 40 + prose(5), "x" * 450, "xy" * 130 + "z", None, "", "  \n\t ", "one", "one", "One", "two words", "é" * 120]
    texts += [prose(4000)]
    texts += [texts[-1][:9000] + " end"]
    langs = ["en", "fr", None, "xx"]
    return [(i, t, langs[i % 4], f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def corpus():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
