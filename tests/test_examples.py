import pandas as pd
import pytest
from pyspark.sql import functions as F

from table_values import values
from tablelink.operators.examples import length_histogram, padded, sample_count, with_input_ids, with_text
from tablelink.plans.pipelines import prepare_examples


def lengths(spark, numbers):
    return spark.createDataFrame([(n,) for n in numbers], "length int")


def test_histogram_bins(spark):
    numbers = [0, 1, 5, 10, 10, 20, 19, 40]
    hist = {r["bin"]: r for r in length_histogram(lengths(spark, numbers[:5]), lengths(spark, numbers[5:])).collect()}
    expected = {}
    for n in numbers:
        expected[min(int(n // 2), 19)] = expected.get(min(int(n // 2), 19), 0) + 1
    assert {b: r["n"] for b, r in hist.items()} == expected
    assert hist[19]["right_edge"] == 40 and hist[0]["left_edge"] == 0
    assert sample_count(lengths(spark, numbers), lengths(spark, [1])).first()["n"] == 9


def test_histogram_of_one_length(spark):
    hist = length_histogram(lengths(spark, [7, 7]), lengths(spark, [7])).collect()
    assert len(hist) == 1 and hist[0]["n"] == 3
    assert hist[0]["left_edge"] <= 7 <= hist[0]["right_edge"]


@pytest.mark.parametrize("tokens,expected", [
    (["a", "b", "c"], ["</s>", "</s>", "<s>", "a", "b", "c", "</s>"]),
    (list("abcdefghi"), ["<s>", "a", "b", "c", "d", "e", "</s>"]),
    ([], ["</s>"] * 5 + ["<s>", "</s>"]),
])
def test_padding(spark, tokens, expected):
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    assert df.select(padded(F.col("t"), "<s>", "</s>", 7)).first()[0] == expected


def test_integer_ids_from_a_pandas_udf(spark):
    @F.pandas_udf("array<int>")
    def lengths_of_words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [len(w) for w in t.split()])

    df = with_text(spark.createDataFrame([("what is", "it")], "question string, answer string"))
    row = with_input_ids(df, 1, 2, lengths_of_words, cap=12).first()
    assert row["input_ids"] == [2, 2, 2, 1, 3, 9, 4, 2, 3, 7, 2, 2]
    assert row["labels"] == row["input_ids"]


def test_prepare_examples(spark):
    schema = "question string, answer string"
    train = spark.createDataFrame([("a b", "c"), ("d", "e")], schema)
    validation = spark.createDataFrame([("f", "g h i")], schema)
    padded_train, padded_validation, hist = prepare_examples(train, validation, "<s>", "</s>", cap=10)
    assert values(padded_train, F.size("input_ids")) == [(10,), (10,)]
    assert padded_validation.count() == 1
    assert sum(r["n"] for r in hist.collect()) == 3
