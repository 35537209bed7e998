"""Question/answer examples: text, tokens, lengths, padding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelink.functions.formats import HISTOGRAM_BINS, MAX_TOKENS
from tablelink.functions.prompts import TEMPLATES, render

# From a text column to an array column; a pandas UDF of a real tokenizer fits.
Tokens = Callable[[Column], Column]


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def with_text(examples: DataFrame) -> DataFrame:
    fields = {"question": F.col("question"), "answer": F.col("answer")}
    return examples.withColumn("text", render(TEMPLATES["sft_train"], fields))


def with_length(examples: DataFrame, tokens: Tokens = word_tokens) -> DataFrame:
    return examples.withColumn("length", F.size(tokens(F.col("text"))))


def padded(tokens: Column, bos, eos, cap: int = MAX_TOKENS) -> Column:
    """Begin and end marks around the tokens, cut to `cap`, filled up on the left.

    The marks count towards the cap and survive the cut; the filling is the end
    mark.
    """
    marked = F.concat(
        F.array(F.lit(bos)), F.slice(tokens, 1, cap - 2), F.array(F.lit(eos))
    )
    return F.concat(F.array_repeat(F.lit(eos), F.lit(cap) - F.size(marked)), marked)


def with_input_ids(
    examples: DataFrame, bos, eos, tokens: Tokens = word_tokens, cap: int = MAX_TOKENS
) -> DataFrame:
    """Add input_ids and its copy, labels."""
    out = examples.withColumn("input_ids", padded(tokens(F.col("text")), bos, eos, cap))
    return out.withColumn("labels", F.col("input_ids"))


def length_histogram(
    train: DataFrame, validation: DataFrame, bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Equal-width bins over the column `length` of both sets, the last one closed.

    Lengths are counted before anything else, so the examples are read once and
    both the bounds and the bins come from one row per distinct length. If all
    lengths are equal, the range is widened by a half on both sides.
    """
    lengths = train.select("length").unionByName(validation.select("length"))
    counts = lengths.groupBy("length").agg(F.count("*").alias("n"))
    low, high = F.min("length").cast("double"), F.max("length").cast("double")
    widen = F.when(low == high, 0.5).otherwise(0.0)
    # The sum keeps the counts per length in the plan of the bounds, so that both
    # read the same shuffle; bounds alone would be taken from the examples again.
    ends = counts.agg(
        F.struct((low - widen).alias("low"), (high + widen).alias("high"), F.sum("n").alias("all"))
    )
    bounds = counts.withColumn("_ends", ends.scalar()).select(
        "length", "n", "_ends.low", "_ends.high"
    )
    width = (F.col("high") - F.col("low")) / bins
    bin_no = F.least(F.floor((F.col("length") - F.col("low")) / width), F.lit(bins - 1))
    return (
        bounds.withColumn("bin", bin_no.cast("int"))
        .groupBy("bin", "low", "high")
        .agg(F.sum("n").alias("n"))
        .select(
            "bin",
            (F.col("low") + F.col("bin") * (F.col("high") - F.col("low")) / bins).alias("left_edge"),
            (F.col("low") + (F.col("bin") + 1) * (F.col("high") - F.col("low")) / bins).alias(
                "right_edge"
            ),
            "n",
        )
    )


def sample_count(train: DataFrame, validation: DataFrame) -> DataFrame:
    return (
        train.select("length")
        .unionByName(validation.select("length"))
        .agg(F.count("*").alias("n"))
    )
