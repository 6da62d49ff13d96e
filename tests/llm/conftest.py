import pytest

LONG = " ".join(f"word{i % 997}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, an extra column for every name
    that an operator makes."""
    text = ["plain words stand here and there for the test of ten or more words", "", None, LONG, "ti.", " \n\t ", "é ü ß word",
            "plain words stand here and there for the test of ten or more words", "<|endoftext|> x"]
    rows = [(i, t, ["en", None, "de"][i % 3], ["a.example.org", None, "http://x.de/y"][i % 3], None if t is None else len(t)) for i, t in enumerate(text)]
    rows += [rows[0], (None, "no id but words, enough of them to be kept by all of the rules", None, None, None), (None, None, None, None, None)]
    extra = ["fingerprint", "component_id", "kept", "bits", "ids", "id", "t", "w", "spans", "base", "language", "n_tokens", "bucket", "fp", "c0", "h",
             "__key", "__id", "__kept", "__best", "best_id", "best_key", "kept_id", "kept_key", "key", "row", "at", "place", "score", "weight",
             "n_words", "batch", "slot", "_rid"]
    return spark.createDataFrame([r + ("x",) * len(extra) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"`{c}` string" for c in extra)).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
