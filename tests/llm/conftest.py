import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, anchor string"


@pytest.fixture
def table(spark):
    """Documents from (id, text) or (id, text, lang, source), with columns whose names operators use themselves."""

    def make(rows):
        rows = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or ""), "x", "y") for r in rows]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make


def long_text(words=30_000):
    return " ".join(f"w{i * 7919 % 5003}" for i in range(words))


EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three"), (6, "one two three"), (7, "a b c d e f g h " * 40), (8, long_text()),
    (9, long_text() + " end"), (10, "é ñ 你好 🙂 <|endoftext|> x  y\r\n"), (6, "one two three"), (11, long_text()), (None, "one two three"),
]


@pytest.fixture
def edges(table):
    return table(EDGES)


@pytest.fixture
def no_rows(table):
    return table(EDGES).limit(0)
