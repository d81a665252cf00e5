import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Nulls in any column, empty and blank texts, repeated rows, one id with two texts, odd characters.
ODD = [
    (1, "one two three four five six seven eight", "en", "a", 10),
    (1, "one two three four five six seven eight", "en", "a", 10),
    (2, "one two three four five six seven eight", None, None, None),
    (3, None, "en", "a", 0),
    (4, "", "en", "a", 0),
    (5, " \t\n ", "en", "a", 4),
    (None, "no id here at all", "en", "a", 5),
    (None, None, None, None, None),
    (6, "Ünïcode İΣ \U0001f600 é ​ \x00 <|endoftext|> 12.5", "de", "b", 30),
    (6, "another text under the same id", "de", "b", 30),
    (7, "a", "en", "a", 1),
    (-8, "negative id", "en", "a", 11),
    (9, "word " * 40_000, "en", "a", 200_000),
    (10, "x" * 300_000, "en", "a", 300_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every oddity, and columns that operators might use for themselves."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, DOCS)
    for name in ("fp", "fps", "score", "bucket", "kind", "root", "tie", "h", "w", "label", "hit_words", "fps_first"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows.cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
