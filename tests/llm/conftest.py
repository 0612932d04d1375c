import pytest

KIND = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row_id string, row_mark string, row string, node int, component long, kept int, words int, "
    "c string, cell int, mark string, place int, number int, length int, paths int"
)
WORDS = [f"w{i * 7919 % 1009}" for i in range(6000)]
PASSAGE = " ".join(f"passage{i}" for i in range(60))
LONG = " ".join(f"word{i * i % 7919}x{i}" for i in range(30_000))


def edge_rows():
    """(doc_id, text, lang, source): nulls, empty, long, near and repeated texts."""
    prose = " ".join(WORDS[:400])
    near = " ".join(WORDS[:40] + ["changed"] + WORDS[41:400])
    rows = [
        (0, None, "en", "a"),
        (1, "", "en", "a"),
        (2, " \n\t ", None, "a"),
        (3, "one two", "en", None),
        (4, "ONE two", "en", "a"),
        (5, prose, "en", "a"),
        (6, near, "en", "a"),
        (7, prose.upper().replace("W", "w"), None, None),
        (8, LONG, "de", "b"),
        (9, LONG + " end", "de", "b"),
        (10, f"before it {PASSAGE} and after\nmore of it", "en", "a"),
        (11, f"elsewhere\n{PASSAGE}\nquite different words here", "en", "b"),
        (12, "same same same " * 40, "en", "a"),
        (13, "line of words\n" * 30, "en", "a"),
        (14, "é😀 ñandú x\x1cy " + PASSAGE, "es", "a"),
    ]
    return rows + [rows[5], rows[10]]


def frame_of(spark, rows):
    """The rows as documents with more columns, whose names the operators use themselves."""
    more = ("x", "y", "z", 1, 2, 3, 4, "c", 5, "m", 6, 7, 8, 9)
    return spark.createDataFrame([(*r, None, *more) for r in rows], KIND)


@pytest.fixture(scope="session")
def edges(spark):
    return frame_of(spark, edge_rows()).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return frame_of(spark, [])
