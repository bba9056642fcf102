import pytest

WORDS = "alder birch cedar douglas elm fir ginkgo hazel ivy juniper katsura larch maple nutmeg oak pine quince rowan spruce tamarack".split()


def prose(seed: int, n: int = 120) -> str:
    """Reproducible made-up prose of n words."""
    import random

    r = random.Random(seed)
    words = ["".join(r.choice(["ka", "lo", "mi", "ren", "tu", "sha", "ne", "vor"]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, long runs of digits, several texts of one id, repeated rows, ties, odd
    characters."""
    long = " ".join(prose(i, 400) for i in range(60))
    rows = [
        (1, "", "en", "a", 0), (2, None, None, None, None), (None, prose(1), "en", "a", 1), (3, long, "xx", "a", 1), (4, prose(2), "en", "a", 1), (4, prose(2), "en", "a", 1),
        (5, prose(2), "de", "b", 1), (6, "  \n\t ", "en", "b", 1), (7, "é́   日本語 😀 <|endoftext|> \x00\x1f", "fr", "b", 1), (8, "one two", "en", "b", 1), (9, "a" * 5000, "en", "b", 1), (None, None, None, None, None),
        (10, "7" * 30_000 + " 1.2.3.4 " + "9" * 5000 + ".1.1.1 password=" + "aB3" * 200, "en", "b", 1), (11, " ".join(prose(10_000 + i, 900) for i in range(170)), "en", "c", 1),
        (12, prose(60), "en", "c", 1), (12, prose(61), "en", "c", 2), (12, None, "en", "c", None),
    ]
    assert len(rows[13][1]) > 1_000_000
    return rows


CLASHING = "tkey string, rank long, key long, v string, comp string, host string, cls int, h long, w string, u int, `_id` long, bands string"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with further columns named like operators' inner ones."""
    extra = tuple([None] * 12)
    return spark.createDataFrame([(*r, *extra) for r in odd_rows], "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
