import pytest


def make(spark, rows, schema="doc_id bigint, text string, source string, lang string, score double, kept string"):
    """Documents with extra columns whose names clash with the operators' own."""
    width = len(schema.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


@pytest.fixture(scope="session")
def docs(spark):
    return lambda rows, **more: make(spark, rows, **more)


PROSE = "the quick brown fox jumps over the lazy dog near a river bank while seven wizards quietly mix potions for the village feast tonight".split()


@pytest.fixture(scope="session")
def prose():
    import random

    def text(seed, n=60):
        rnd = random.Random(seed)
        return " ".join(rnd.choice(PROSE) + str(rnd.randint(0, 99)) for _ in range(n))

    return text
