"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scratch import checkpoint_folder, drop_scratch, materialise
from tessera.sources import tables

__all__ = ["checkpoint_folder", "connected_components", "drop_scratch", "materialise", "read_table", "unsigned_crc32", "word_list"]

# Bytes of a lower-cased word: digits, a-z and everything from 0x80 on; the rest separates.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def word_list(text: bytes | None) -> list[bytes]:
    """Lower-cased alphanumeric words of UTF-8 bytes; null and empty texts have none."""
    return text.translate(WORD_BYTES).split() if text else []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; small ones whose rows take much work are dealt out to all cores."""
    return tables.read_table(spark, sf_dir, name, spread=name in ("documents", "pages"))


def unsigned_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes; a null text counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): each node of ``edges(src, dst)`` with the smallest node it reaches.

    Alternates large-star and small-star rounds. Minima are combined before
    their shuffle; the join of a hub's neighbours with its minimum is a plain
    shuffle join of single rows, which adaptive execution splits where one hub
    has many, and no neighbourhood is ever gathered. The edge list stays
    distributed and is cut to storage once per round. The driver sees two numbers per round. Self-loops and repeated
    edges are harmless; an empty edge list gives an empty result.
    """

    def pairs(df: DataFrame) -> DataFrame:
        return df.where("src <> dst").select(
            F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
        ).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(
            df.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        )

    current = materialise(pairs(edges), name)
    before = state(current)
    while before[0]:
        both = current.select("src", "dst").union(current.select("dst", "src"))
        low = both.groupBy("src").agg(F.min("dst").alias("low"))
        large = (
            both.join(low, "src")
            .where(F.col("dst") > F.col("src"))
            .select(F.col("dst").alias("src"), F.least("src", "low").alias("dst"))
        )
        large = materialise(pairs(large), name)
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        small = small.union(low.select("src", F.col("low").alias("dst")))
        current = materialise(pairs(small), name)
        after = state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return current.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
