from __future__ import annotations

import random

import pytest

#: Rows that each operator has to stand: nulls, empty and blank texts, copies, repeated rows, a long word, marks.
STRANGE = [
    (None, "a row without an id says this"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "one"),
    (6, "x" * 3000 + " end"),
    (7, "é" * 50 + " ünder "),
    (8, "repeated row with a few words in it"),
    (8, "repeated row with a few words in it"),
    (9, "same id, first text of the two"),
    (9, "same id, other text of the two"),
    (10, "null \u0000 byte and   line separator"),
]


def prose(r: random.Random, n: int, words: int = 400) -> str:
    return " ".join("".join(r.choice(("an", "the", "ou", "er", "sti", "é", "ba")) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def strange(spark):
    return spark.createDataFrame([(i, t, "l", "s", 7) for i, t in STRANGE], "doc_id long, text string, lang string, source string, kept int")


@pytest.fixture(scope="session")
def corpus() -> list[tuple[int, str]]:
    """Documents with exact and near copies, shared passages and one long text."""
    r = random.Random(11)
    shared = prose(r, 40)
    rows: list[tuple[int, str]] = []
    for i in range(60):
        text = prose(r, r.randint(1, 200))
        if i % 5 == 0:
            text = f"{text}\n{shared} {prose(r, 5)}"
        if i % 7 == 3:
            text = rows[-1][1]
        if i % 7 == 5:
            words = rows[i - 3][1].split(" ")
            if len(words) > 60:
                words[len(words) // 2] = "changed"
            text = " ".join(words)
        rows.append((i, text))
    rows.append((60, prose(r, 5000) + " " + shared))
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


#: Columns of a caller that operators might name their own like.
CLASHING = ["_bag", "_own", "_id", "_n", "_digest", "own_bag", "Kept_ID", "kept_bag", "kept_digest", "own_digest", "number", "n_words", "n_hit", "items", "contaminated", "selected", "expected_grade", "tail_probability", "digest", "bag", "size", "id", "_text", "_row", "row_key", "shard", "label", "kept"]


@pytest.fixture(scope="session")
def clashing(spark, corpus):
    """Documents whose further columns are named like those that operators add."""
    rows = [(i, t, *[f"{c}{i}" for c in CLASHING]) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(2)


def whole(left, docs) -> bool:
    """Whether the rows that are left have all their columns as they came."""
    rows = {r["doc_id"]: r for r in docs.collect()}
    return left.columns == docs.columns and all(r == rows[r["doc_id"]] for r in left.collect())
