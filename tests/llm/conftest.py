import pytest

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, `of` string, passes double, place string, gone string, `row` long, score double, d long, n long, label string, shard long, at long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names operators might use."""

    def make(rows):
        full = [(i, t, s, "en", len(t or ""), "x", 1.5, "y", "z", 7, 0.5, 3, 4, "l", 5, 6) for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
LONG = " ".join(f"w{k % 997}x{k % 31}" for k in range(60_000))
ODD = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \n\t ", None),
    (None, "one two three four five six seven", "b"),
    (4, "one two three four five six seven", "b"),
    (4, "one two three four five six seven", "b"),
    (5, "one two three four five six seven", "b"),
    (6, LONG, "c"),
    (7, "x", "c"),
    (8, "no-spaces" * 20_000, "c"),
    (9, "\n".join(["same line here"] * 6), None),
]


@pytest.fixture(scope="session")
def odd(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([]).limit(0)
