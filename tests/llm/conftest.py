import pytest

DOCS = "lang string, text string, source string, n_chars long, part string, halo string, shard string, lang_pred string, pii string, d1 long, gone long, kept string, rep long, `a.b` string, doc_id long"


@pytest.fixture
def make(spark, tmp_path):
    """A folder with a documents table of the given (doc_id, text) rows and columns whose names clash with inner ones; doc_id comes last."""

    def build(rows, langs=None):
        full = [((langs or {}).get(i), t, "s", len(t or ""), "p", "h", "x", "l", "q", 1, 2, "k", 3, "y", i) for i, t in rows]
        spark.createDataFrame(full, DOCS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return build


ODD = [(1, "a b"), (2, None), (3, ""), (4, "a b"), (4, "a b"), (5, " \t\n"), (None, "x y z"), (7, "word " * 30000), (8, "é\U0001f600 ß"), (9, None)]


@pytest.fixture
def odd():
    return ODD
