"""The corpus pipeline: language, near duplicates, personal data, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; all but
the last return the columns of documents. run() writes each stage's rows to the shared folder
and reads them again for the next.

Cases: documents whose language can't be told (null or letterless texts) are left by the first
stage, so later stages see texts with letters; an empty table goes through all stages empty;
extra columns of documents stay to the last stage but one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequill.llm import language_id, mixing, near_dups, pieces, surrogates
from tracequill.llm.common import discard, materialize

#: Least share of a text's best language among all for the text to stay.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language of sufficient share; lang becomes what was predicted."""
    predicted = language_id.predict(docs, language_id.train(docs), ("__lang", "__share"))
    known = predicted.filter((F.col("__lang") != language_id.UNDETERMINED) & (F.col("__share") >= LEAST_SHARE))
    return known.select(*[F.col("__lang").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dups.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars is that of the new text."""
    replaced = surrogates.replace(docs)
    return replaced.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and checks of every document."""
    return pieces.round_trip(docs, finer=2)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("piece_ids", piece_ids),
]

#: Models fitted by iteration and keyed random numbers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
