import random

import pytest

WORDS = "the of and to in that was for with his der die und von que los del est les une sur avec pas".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "er", "o"]) for _ in range(n))


def rows(seed=0, n=60):
    """Texts with nulls, empty and blank ones, copies, near copies, shared passages, a long one, and a repeated row."""
    rng = random.Random(seed)
    passage = text(rng, 80)
    out = []
    for i in range(n):
        kind = i % 12
        t = text(rng, rng.randint(1, 120))
        if kind == 3:
            t = text(rng, 20) + " " + passage + " " + text(rng, 10)
        if kind == 5 and out:
            t = out[rng.randrange(len(out))][1]
        if kind == 7:
            words = passage.split()
            words[rng.randrange(len(words))] = "changed"
            t = " ".join(words)
        out.append((i, t, ["en", "de", None][i % 3], ["a", "b", "c", None][i % 4]))
    out += [(n, None, "en", "a"), (n + 1, "", "en", "a"), (n + 2, " \n\t ", None, None), (n + 3, "Ärger 数字 ß!", "de", "b"), (n + 4, text(rng, 9000), "en", "b"), (None, "no name", "en", "c")]
    return [*out, out[1], out[1]]


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark):
    """With extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    for name in ("id", "fp", "n", "key", "keep", "digest", "locator", "size", "copies", "kept", "block", "salt"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return [(i, t or "") for i, t, _, _ in rows()]
