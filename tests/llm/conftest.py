import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def corpus(seed: int = 3) -> list[tuple]:
    """Texts with exact and near copies, a shared passage, nulls, empties, ties, repeats and one long text."""
    rng = random.Random(seed)
    rows, n = [], 0

    def add(text, lang="en", source="a"):
        nonlocal n
        rows.append((n, text, lang, source, None if text is None else len(text)))
        n += 1

    passage = prose(rng, 40)
    for size in (3, 4, 5, 6, 7, 12, 25, 60, 200, 400):
        for _ in range(3):
            base = prose(rng, size)
            add(" ".join(base), source=rng.choice("abc"))
            add("  " + "\n".join(base).upper() + " ")
            for edits in (1, 1, 2, 3, 5, 8):
                copy = list(base)
                for _ in range(max(1, edits * size // 100)):
                    copy[rng.randrange(len(copy))] = "".join(prose(rng, 1))
                add(" ".join(copy), source=rng.choice(["a", "b", None]))
    for _ in range(30):
        add(" ".join(prose(rng, rng.randint(5, 30)) + passage + prose(rng, rng.randint(5, 30))))
    base = prose(rng, 150)
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = "".join(prose(rng, 1))
        add(" ".join(copy))
    for text in (None, None, "", "", " \n\t", "one", "one", "ONE", "ünï çödé ÜNÏ"):
        add(text, lang=None, source=None)
    add(" ".join(prose(rng, 30_000)), source="long")
    add("x" * 50_000, source="long")
    rows.append((None, rows[0][1], None, None, None))
    rows.append((5, rows[5][1], "en", "a", None))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from meterline.llm.queries import _workers_find_us

    _workers_find_us(spark)
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
