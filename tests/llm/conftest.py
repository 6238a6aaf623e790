import pytest

SF = "/root/testdata/sf0.001"

#: A small table with the cases every operator must take: nulls, empty and blank texts, ties, repeated rows, a long text.
CASES = [
    (1, "the cat sat on the mat and the dog lay by the fire all night long", "en", "a"),
    (2, "the cat sat on the mat and the dog lay by the fire all night long", "en", "a"),
    (2, "the cat sat on the mat and the dog lay by the fire all night long", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \n\t ", "en", "b"),
    (None, "le chat est sur le tapis et le chien dort", "fr", None),
    (6, "one two", "en", "c"),
    (7, "Äpfel öffnen ÜBER straße " * 3000, "de", "c"),
    (8, "12345 67890 !!!", None, "c"),
]


@pytest.fixture(scope="session")
def cases(spark):
    rows = [(i, t, lang, s, len(t or ""), "x", 1) for i, t, lang, s in CASES]
    # Extra columns with names that operators use inside.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, score int")


@pytest.fixture(scope="session")
def nothing(cases):
    return cases.limit(0)
