import pytest

LONG = " ".join(f"word{i}" for i in range(30_000))
PASSAGE = " ".join(f"alpha{i} beta{i}" for i in range(40))
# (doc_id, text): null, empty, blank, repeated rows, a null id, a very long line, copies, near copies, odd characters
ROWS = [
    (1, None), (2, ""), (3, " \n\t \r\n"), (4, "one"), (4, "one"), (5, PASSAGE), (6, PASSAGE), (7, PASSAGE + " tail"),
    (None, PASSAGE), (None, None), (8, LONG), (9, "Ünïcode \x01\x02 text 😀 a@b.co +1 (555) 555-0000"), (10, "same line of some length, said twice\n" * 3),
    (11, PASSAGE.upper()), (12, "a\nb\nc"), (13, "x" * 5000),
]
CLASH = "id long, text_key string, key int, n int, kept boolean, row string, line string, h long, removed int, n_words int, sig int, value string, uid int"


@pytest.fixture(scope="session")
def rough(spark):
    """Documents of every awkward kind, with columns that share names with inner ones."""
    extra = (7, "k", 1, 2, False, "r", "l", 3, 4, 5, 6, "v", 8)
    return spark.createDataFrame([(*r, *extra) for r in ROWS], f"doc_id long, text string, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def none(rough):
    return rough.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (8, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
