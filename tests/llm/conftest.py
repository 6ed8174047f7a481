import pytest


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing column names."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [
        (0, "Alpha beta gamma delta", "en", 1), (1, None, None, None), (2, "", "en", 2), (None, "Alpha beta gamma delta", "fr", 3), (None, None, None, None), (3, long, "en", 4), (4, long.upper(), "en", 5),
        (5, "alpha BETA gamma delta", "en", 6), (0, "Alpha beta gamma delta", "en", 1), (6, "\n\n \t", "xx", 7), (7, "é ß 漢字 🎉 <|endoftext|> \x00", "xx", 8), (-9, "x" * 40_000, "xx", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
