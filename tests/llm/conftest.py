import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, key int, hex int, node int, fp int, `row` int, body int, p int, part int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
    run = " ".join(f"same{i}" for i in range(60))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog again and again"), (2, "The quick brown fox jumps over the lazy dog again and again"),
        (3, "the  quick brown\tfox jumps over the lazy dog again and again"), (3, "the  quick brown\tfox jumps over the lazy dog again and again"),
        (4, ""), (5, None), (None, None), (None, "no id here"), (None, "no id here"), (6, " \n\t "), (7, long), (8, long + " tail"), (9, run + " a b c"), (10, "x y " + run),
        (11, "é<|endoftext|> ÜBER İstanbul ΟΔΟΣ 12'll"), (12, "a"), (13, "a"), (14, "zz " * 500), (15, "ab" * 900), (20, run),
    ]
    rows = [(i, t, "en" if n % 3 else None, f"s{n % 4}" if n % 5 else None, None, "z", "z", 1, 1, 1, 1, 1, 1, 1, 1) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
