import pytest


@pytest.fixture
def docs(spark):
    """Documents from texts; ids count from 0 unless given as (id, text)."""
    def make(texts, extra="", values=()):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(*r, *values) for r in rows], "doc_id bigint, text string" + extra)
    return make


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


WORDS = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "ginkgo", "hazel", "ivy", "juniper", "larch", "maple", "oak",
         "pine", "quince", "rowan", "spruce", "teak", "willow", "yew"]


def prose(seed, n):
    """`n` words that depend on the seed."""
    import random
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(90)) for _ in range(n))
