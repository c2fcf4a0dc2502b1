"""A corpus pipeline: quality rules, line and document deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on every row that the stage
before it kept, and all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, lines, minhash, packing, quality
from tessera.llm.common import materialise, read_table
from tessera.llm.queries import TOKENIZER


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a row number that a lost executor cannot change: it is written down."""
    return materialise(docs.select("*", F.monotonically_increasing_id().alias("__row")), "rows")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject.

    Labels are those of the input tables. Null, empty and blank texts have no
    words and go; repeated rows are judged one by one and alike; rows without an
    id are judged without a label; of scores equal to the cut all stay; texts
    are read whole; an empty table stays empty.
    """
    labels = read_table(spark, sf_dir, "labels")
    judged = quality.quality_rules(docs, labels, carry=True)
    return judged.where("__kept").select(*(F.col(f"`{c}`") for c in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines out of the texts; a text that this leaves without a word goes.

    ``n_chars`` follows the new text. Empty texts that were empty before stay,
    and null texts stay null. Of equal lines the one of the smallest id and first
    place stays; rows that share an id count as one document and stay alike;
    rows without an id lose only their own repeats; lines of under 30 characters
    go if they are equal to an earlier one and hold a letter or a digit. Texts are read whole; an empty table stays empty; other columns go on.
    """
    cleaned = lines.dedup_lines(docs, prefix="__")
    emptied = (F.col("__n_removed") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    # the marker keeps this filter from being repeated below the text's expression
    cleaned = cleaned.withColumn("__gone", emptied & (F.spark_partition_id() >= 0)).where("not __gone")
    columns = [F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return cleaned.select(*columns)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies, of Jaccard 0.8 or more.

    Rows that share this id are repeats of one document: one row of them
    stays. Rows without an id are linked with nothing and stay.
    """
    rows = _keyed(docs)
    kept = minhash.near_duplicates(rows, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    first = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("__row").alias("__row"))
    stay = first.join(kept, "doc_id", "left_semi").select("__row")
    stay = stay.union(rows.where("doc_id is null").select("__row"))
    return rows.join(stay, "__row", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents and cuts benchmark passages out of the others.

    ``n_chars`` follows the new text; null texts stay null and empty ones empty.
    Repeated rows are judged one by one and alike; rows without an id are judged
    like others; texts are read whole; an empty table stays empty, and an empty
    benchmark leaves every row as it is.
    """
    found = decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), remove_spans=True, carry=True)
    kept = found.where(~F.col("__contaminated"))
    columns = [
        F.col("__clean_text").alias(c) if c == "text" else F.length("__clean_text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`")
        for c in docs.columns
    ]
    return kept.select(*columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    Null and empty texts are one id; repeated rows and null ids are packed like
    others; an empty table gives no rows. Other columns do not go on.
    """
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", minhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# Packing tokenises, which SQL cannot express; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
