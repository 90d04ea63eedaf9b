import pytest

pytest.importorskip("tidemark.llm")

LONG = "w%d " * 5
#: Null and empty texts, white space alone, ties, repeated rows, a very long text, odd characters.
ODD_TEXTS = [
    (1, "The cat sat on the mat, and the dog looked on from the door."),
    (2, "The cat sat on the mat, and the dog looked on from the door."),
    (2, "The cat sat on the mat, and the dog looked on from the door."),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, "three short words"),
    (7, "Three Short Words"),
    (8, " ".join(f"w{i % 977}" for i in range(30_000))),
    (9, "日本語 ▁ text \x00 <|endoftext|> <s> 😀  two  spaces İ K"),
    (10, "a"),
    (None, "a text without an id, of more than five words"),
]


@pytest.fixture
def odd_docs(spark):
    """Documents with a row for every odd case, and columns whose names clash with those operators make."""
    rows = [(i, t, None, None, 7, 0.5, "x", 1) for i, t in ODD_TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, labels string, sid int")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture
def odd_labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (4, None, None), (5, 0, 0), (6, 1, 1), (6, 1, 1), (999, 1, 0), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
