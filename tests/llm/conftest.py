import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(*texts, first=0):
        rows = [(first + i, t, "en", f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOC)

    return make
