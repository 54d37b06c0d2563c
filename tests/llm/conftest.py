import pytest

ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta. " * 3),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "Alpha beta gamma delta epsilon zeta eta theta. " * 3),
    (5, "Alpha beta gamma delta epsilon zeta eta theta. " * 3),
    (None, "A row without an id, with İ ſ é́ 日本 🙂 and \x1c controls"),
    (None, None),
    (7, "It's <|endoftext|> <|ENDOFTEXT|> I'll 12½ x²  token"),
    (8, "word " * 6000 + "tail"),
    (9, "x" * 30000),
    (10, "one"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, blanks, repeats, unusual letters and columns that clash."""
    rows = [(d, t, "en", "s", 1, 2.0, "k") for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, node string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture
def sf(odd, none, tmp_path):
    """A folder of tables: the odd documents, or no documents."""

    def made(empty=False, **tables):
        where = tmp_path / ("empty" if empty else "odd")
        (none if empty else odd).write.parquet(str(where / "documents.parquet"))
        for name, df in tables.items():
            df.write.parquet(str(where / f"{name}.parquet"))
        return str(where)

    return made
