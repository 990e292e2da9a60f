import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties, and names that operators use themselves."""
    long_text = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox, jumps over it!\nshared line of text\nend", "en", "a"),
        (2, "other words here now\nSHARED line of text \nend", "en", "a"),
        (2, "other words here now\nSHARED line of text \nend", "en", "a"),
        (3, None, None, None),
        (4, "", "", "b"),
        (None, "no id at all, but text\nshared line of text", "en", "b"),
        (5, long_text, "en", "hot"),
        (6, long_text + " tail", "en", "hot"),
        (7, "   \n\t\r\n ", "xx", "b"),
        (8, "The quick brown fox, jumps over it!\nshared line of text\nend", "en", "a"),
        (9, "naïve café — 中文 <|endoftext|> it's don't 42", "fr", "a"),
    ]
    schema = "doc_id bigint, text string, lang string, source string, d bigint, n bigint, value double, key string, n_lines string"
    return spark.createDataFrame([(*r, 7, 8, 9.0, "k", "clash") for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, None, 0), (None, 1, 0), (5, 1, 0), (5, 0, 0)], "doc_id bigint, quality int, toxic int")
