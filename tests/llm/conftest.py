"""Small tables that every operator must take: nulls, empty and blank texts, repeated
rows, ties, a text longer than a block, and extra columns with names used inside."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, run string"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, lang="en", source="src1"):
        """``(doc_id, text)`` pairs as a documents table."""
        return spark.createDataFrame(
            [(i, t, lang, source, None if t is None else len(t), 7, "x", None) for i, t in rows], DOCS
        )

    return make


def words(seed, count, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(count))


@pytest.fixture(scope="session")
def odd_rows():
    """Texts with copies, near copies, shared passages and every odd case."""
    base, passage = words(1, 200), words(2, 70)
    near = base.split()
    near[100] = "changed"
    return [
        (5, base), (3, base), (9, " ".join(near)), (9, " ".join(near)), (11, base.upper()),
        (20, words(3, 60) + " " + passage + " " + words(4, 60)), (21, passage), (22, words(5, 30) + "\n" + passage),
        (30, None), (31, ""), (32, " \t\n"), (33, "one two"), (34, "one two"), (35, "One two"),
        (None, base), (None, None), (40, "x" * 300_000 + " " + words(6, 20)), (41, "ab " * 5000),
        (42, "a\u00a0b \u00e9t\u00e9 caf\u00e9"), (43, words(7, 49)), (44, words(7, 50)),
    ]


@pytest.fixture(scope="session")
def odd_docs(docs_of, odd_rows):
    return docs_of(odd_rows).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs_of):
    return docs_of([])
