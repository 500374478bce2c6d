import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.checkpoint.dir", f"file://{folder}").getOrCreate()
    yield s


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


LONG = "Ein langer Satz über Bäume, 日本語 und mehr. " * 400
#: Nulls, empty texts, repeats, very long texts and odd characters.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, LONG), (7, LONG + "x"), (None, "no id at all, but words"), (None, None), (8, "a" * 5000),
    (9, "naïve café — “quotes” 😀 <|endoftext|> it's\r\n\r\n   end"), (10, "1234 5678 " * 60), (11, "The end.\nThe end.\nMenu | Home | About\nNo mark\n"), (12, "\x00\x0b zero"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
