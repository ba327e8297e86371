import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NASTY = "doc_id long, text string, lang string, source string, n_chars long, size string, `score` int, fp string, shard_id int, kept int, lines int, n_words string, leaf int, local string, bucket_bytes int, bucket_docs int, first int, b int, n int, d int, p int, copies int, target int, html string, bits int, root int, base string, labels int"

LINE = "the quick brown fox jumps over the lazy dog while seven wizards brew strong tea and read old maps near the river"


def _rows():
    long = " ".join(f"word{i % 977} and" for i in range(30_000))
    out = [
        (1, LINE, "en", "a"), (2, LINE, "en", "a"), (2, LINE, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \t\n ", "de", "b"),
        (None, LINE + " again", "en", "a"), (None, LINE + " again", "en", "a"), (None, None, None, None), (6, long, "en", "a"), (7, long + " end", "en", None),
        (8, "Ünïcödé 😀 straße\x0bvertical\x0cfeed", "de", "é"), (9, "one", "en", "b"), (10, "one two", "en", "b"), (11, "one two three", "en", "c"),
        (12, "Licensed under the MIT License, and the Apache License, Version 2.0; CC-BY-NC too. mit license", "en", "c"),
        (13, "mail a.b@mail.example.com or x@y or @z.com b@c.d@e.f 10.0.0.1 300.1.1.1 1.2.3.4.5.6 +1 (487) 555-7209 card 4111 1111 1111 1111 and 4111111111111112", "en", "c"),
        (14, "12345 !!! ???", None, "c"), (15, "x\ny\nx\n\nx y\n" * 40, "en", "d"),
        (16, "a b c a b c a b c d e f " * 30, "en", "d"), (17, "<|endoftext|> 'll we've   spaces\n\n\n", "en", "d"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in out]


@pytest.fixture(scope="session")
def rows():
    return _rows()


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty, very long and repeated texts, ties."""
    return spark.createDataFrame(_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def clashing(spark):
    """The same with columns named like the operators' own."""
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4, "z", 5, "l", 6, 7, 8, 9, 10, 11, 12, 13, 14, "<p>", 15, 16, "base", 17) for r in _rows()], NASTY)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
