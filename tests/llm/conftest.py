import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, empty, wordless, tied, repeated and long texts, and null ids.
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 4), (4, "one", "en", "a", 3),
    (5, "The quick brown fox jumps over the lazy dog", "en", "b", 1), (5, "The quick brown fox jumps over the lazy dog", "en", "b", 1),
    (6, "the QUICK brown fox jumps over the lazy dog", "en", "b", 1), (None, "lost row of words", "en", "b", 1),
    (7, "été ÉTÉ naïve & co. # $ | <b> x\n été ÉTÉ naïve & co. # $ | <b> x\n", "fr", "c", 1), (8, "long word " * 4000, "en", "c", 1),
    (9, "a b\x1cc\x0bd\x85e", "en", "c", 1), (10, "x" * 100_000, "en", "c", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward documents, with extra columns that clash with output names."""
    from pyspark.sql import functions as F

    extra = ("text_", "words", "n_words", "kept", "fp", "shard", "slot", "size", "component_id", "point", "label", "word", "pos")
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
