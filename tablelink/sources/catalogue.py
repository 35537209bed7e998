"""The known datasets and the files that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tablelink import schemas
from tablelink.sources.files import read_candidates, read_table_meta

# Dataset, candidate file, title file.
KNOWN = (
    ("Round1_T2D", "Round1_T2D_f3.csv", "Round1_T2D.csv"),
    ("Round3_2019", "Round3_f3.csv", "Round3.csv"),
    ("2T_Round4", "2T-2020_f3.csv", "2T_Round4.csv"),
    ("Round4_2020", "Round4_f3.csv", "Round4.csv"),
    ("HardTablesR2", "HardTableR2-2021_f3.csv", "HardTableR2.csv"),
    ("HardTablesR3", "HardTableR3-2021_f3.csv", "HardTableR3.csv"),
)


def catalogue(spark: SparkSession, entries=KNOWN) -> DataFrame:
    return spark.createDataFrame(list(entries), schemas.CATALOGUE)


def resolve(known: DataFrame, dataset: str, candidates_file: str, title_file: str) -> Row:
    """The catalogue row of a triple; names that do not belong together are an error."""
    wanted = (
        (F.col("dataset") == dataset)
        & (F.col("candidates_file") == candidates_file)
        & (F.col("title_file") == title_file)
    )
    row = known.where(wanted).first()
    if row is None:
        raise ValueError(
            f"no dataset {dataset!r} with files {candidates_file!r} and {title_file!r}"
        )
    return row


def read_dataset(
    spark: SparkSession, known: DataFrame, dataset: str, folder: str, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Candidates and titles of a dataset of the catalogue, from the files it names below
    `folder`. An unknown name is an error before a file is read."""
    row = known.where(F.col("dataset") == dataset).first()
    if row is None:
        raise ValueError(f"no dataset {dataset!r} in the catalogue")
    return (
        read_candidates(spark, f"{folder}/{row['candidates_file']}", multi_line),
        read_table_meta(spark, f"{folder}/{row['title_file']}", multi_line),
    )
