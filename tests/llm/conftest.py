"""Documents for the operators' tests: a small table with odd rows, and generated vectors."""

import numpy as np
import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string, h int, n int, key string, spans string, tokens string, tree string, score string"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", "x", 1, 2, "k", "s", "t", "r", "c")


ODD = [
    row(1, "One line that many documents share here.\nsecond line"),
    row(2, "  ONE line that many documents share here. \n\nthird line of its own, with words"),
    row(3, "One line that many documents share here.\t\r\nA line"),
    row(4, "One line that many documents share here.\nOne line that many documents share here."),
    row(5, None, None, None),
    row(6, "", "fr", "b"),
    row(7, " \n\t ", None, "b"),
    row(8, LONG + "\n" + LONG, "en", "b"),
    row(9, LONG + "\n" + LONG, "en", "b"),
    row(9, LONG + "\n" + LONG, "en", "b"),
    row(10, "word " * 3000 + "é" * 5000, "fr", "c"),
    row(11, "x" * 20_000, None, "c"),
    row(None, "a document without an id, in a few words", "en", "a"),
    row(None, None, None, None),
    row(12, "Été à la plage, où es-tu? 12345 <|endoftext|> \U0001f600 ſecret ß", "fr", None),
    row(13, "12345 !!! ???", "en", "a"),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SHAPE)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture
def vectors(spark):
    """Clustered vectors with copies of one, ties, and rows that take no part."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 600)] + 0.4 * rng.normal(size=(600, 16))).astype("float32")
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    rows += [(600 + i, rows[40][1], 0) for i in range(60)]
    rows += [(700, None, 0), (710, [float("nan")] * 16, 0), (720, [None] * 16, 0), (750, [0.0] * 16, 0), (None, rows[3][1], 0), (761, [float("inf")] + [0.0] * 15, 0), (100, rows[100][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
