import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) rows, with the other columns and ones that clash with those of results."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string"
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.0, "x") for i, t in rows], schema)

    return make


#: Texts that operators must not stumble over.
ODD = ["", " ", "\n\n", "a", "no space " + "x" * 5000, "ab " * 3000, "日本語のテキスト。" * 40, "naïve café 😀😀 zero\x00byte", "line\nline\nline", "<|endoftext|> </s>[INST] \\<s>", "tab\tand\x0bvertical\x85next　wide"]


@pytest.fixture(scope="session")
def odd_rows():
    rows = [(i, t) for i, t in enumerate(ODD)]
    return [*rows, (len(rows), None), (None, "no id"), (0, ""), (3, "a")]
