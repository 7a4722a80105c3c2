import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, _h string, rank int, words string, pii string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names the operators use themselves."""

    def run(texts, sources=None, ids=None):
        rows = []
        for i, t in enumerate(texts):
            rows.append((ids[i] if ids else i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or ""), 9, "x", "h", 1, "w", "p"))
        return spark.createDataFrame(rows, SCHEMA)

    return run


ODD = [None, "", " \n\t ", "one", "one two", "Ünï cödé ", "one two three four", "one two three four", "x" * 5000, "long " * 30000, None, ""]
