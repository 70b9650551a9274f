import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Texts with every odd case: null, empty, no words, odd white space, very long, repeated.
ODD = [
    None, "", " ", "\n\n", "***", "one", "a\tb \t c\x1c d e", "ein  Text   mit\n\n Lücken ", "日本語 текст 🙂 x'll 3½ ²", "y" * 5000,
    "word " * 8000, "<|endoftext|> in a text", "Straße ǅ İ ﬁ", "Released under the MIT License. " * 3,
]


@pytest.fixture
def documents(spark):
    """A documents table from texts; a row that is a tuple is (doc_id, text, source)."""

    def make(texts, extra=None):
        rows = []
        for i, t in enumerate(texts):
            doc_id, text, source = t if isinstance(t, tuple) else (i, t, f"src{i % 3}" if i % 5 else None)
            rows.append((doc_id, text, "en", source, None if text is None else len(text)))
        df = spark.createDataFrame(rows, SCHEMA)
        for name in extra or ():
            df = df.selectExpr("*", f"doc_id AS `{name}`")
        return df

    return make


@pytest.fixture
def odd(documents):
    """Odd texts with a repeated row, a null key, and columns whose names operators use themselves."""
    return documents([*ODD, (3, "\n\n", "src0"), (None, "a text without a key", None)], ["kept", "node", "key", "word", "value", "score", "_text", "_key"])
