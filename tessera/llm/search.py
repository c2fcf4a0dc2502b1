"""Ranked lexical search over document shards of integer impacts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BYTES, materialise, word_list

SHARD_BYTES = 16 << 20  # of text: about 15 MB of postings
BLOCK_TERMS = 250_000  # query terms that are sent to the executors at a time
MERGERS = 512  # buckets of shards whose best rows meet before those of all shards do


@dataclass
class Index:
    """``shards``: a row for each shard of documents; and two counts over all of them.

    A shard holds ``ids`` of its documents in ascending order, its ``terms`` in
    ascending order, and postings in compressed rows: those of term i lie from
    ``starts[i]`` to ``starts[i + 1]`` of ``docs`` (places in ``ids``) and ``impacts``.
    The three are little-endian int64, int32 and int32.
    """

    shards: DataFrame
    n_docs: int
    n_terms: int


def count_terms(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and all terms with their repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [len(word_list(t.as_py())) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, sizes))], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["docs", "terms"])

    rows = docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "docs long, terms long")
    found = rows.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return found.docs or 0, found.terms or 0


def shard_of(ids: pa.Array, texts: list[bytes], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """The row of a shard of these documents, of which each has a term."""
    order = pc.sort_indices(ids, null_placement="at_start")
    lists = pc.ascii_split_whitespace(pa.array([texts[i] for i in order.to_pylist()], pa.large_binary()).view(pa.large_string()))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.view(pa.large_binary())
    by_word = pc.sort_indices(words).to_numpy()
    place = np.empty(len(words), np.int64)
    place[by_word] = np.arange(len(words))
    pairs = place[coded.indices.to_numpy()] * len(sizes) + np.repeat(np.arange(len(sizes)), sizes)
    pairs, tf = np.unique(pairs, return_counts=True)
    doc = pairs % len(sizes)
    m = 100 - 25 + (25 * sizes * n_docs) // n_terms
    impacts = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
    starts = np.searchsorted(pairs // len(sizes), np.arange(len(words) + 1))
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    blob = lambda a, kind: pa.array([a.astype(kind).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays(
        [one(ids.take(order)), one(words.take(pa.array(by_word)).cast(pa.binary())), blob(starts, "<i8"), blob(doc, "<i4"), blob(impacts, "<i4")],
        ["ids", "terms", "starts", "docs", "impacts"],
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """Index every document with a term; the shards are written to the shared folder.

    A task closes a shard when its texts reach ``shard_bytes``, so it holds one
    shard, and a longer text is a shard of its own. Impacts are
    10^9 tf div (1000 tf + 12 m), where m = 75 + 25 n N div L follows the length
    n of a document; N and L are counted in a pass before.
    """
    n_docs, n_terms = count_terms(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for b in batches:
            for at, value in enumerate(b.column(1)):
                text = (value.as_py() or b"").translate(WORD_BYTES).strip()
                if text:
                    ids.append(b.column(0).slice(at, 1))
                    texts.append(text)
                    size += len(text)
                if size >= shard_bytes:
                    yield shard_of(pa.concat_arrays(ids), texts, n_docs, n_terms)
                    ids, texts, size = [], [], 0
        if texts:
            yield shard_of(pa.concat_arrays(ids), texts, n_docs, n_terms)

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"ids array<{kind}>, terms array<binary>, starts binary, docs binary, impacts binary"
    shards = docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, schema)
    return Index(materialise(shards, "shards"), n_docs, n_terms)


@dataclass
class Queries:
    """A block of queries: query i has terms ``codes[starts[i]:starts[i + 1]]``, each so many ``times``."""

    keys: np.ndarray
    starts: np.ndarray
    codes: np.ndarray
    times: np.ndarray
    terms: pa.Array

    def places(self, terms: pa.Array) -> np.ndarray:
        """Place of each of the block's terms in a shard's ``terms``, -1 where it has none."""
        return pc.fill_null(pc.index_in(self.terms, value_set=terms), -1).to_numpy(zero_copy_only=False)


def query_blocks(queries: DataFrame, block_terms: int) -> Iterator[Queries]:
    """Queries (k, text) in blocks of about ``block_terms`` distinct terms, dealt by a hash of k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, w, n) for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for w, n in Counter(word_list(t.as_py())).items()]
            columns = zip(*rows, strict=True) if rows else [()] * 3
            kinds = [pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["k", "w", "n"])

    terms = materialise(queries.select("k", F.col("text").cast("binary")).mapInArrow(run, "k long, w binary, n long"), "query-terms")
    blocks = -(-terms.count() // block_terms)
    for block in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == block)
        # bounded by the size of a block
        table = mine.toArrow().combine_chunks().sort_by("k")
        if table.num_rows:
            coded = table.column("w").combine_chunks().dictionary_encode()
            keys, starts = np.unique(table.column("k").to_numpy(), return_index=True)
            yield Queries(keys, np.append(starts, table.num_rows), coded.indices.to_numpy(), table.column("n").to_numpy(), coded.dictionary)


def document_counts(index: Index, sent) -> dict[int, int]:
    """How many documents hold each term of the block that ``sent`` carries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        total = np.zeros(len(block.terms), np.int64)
        for b in batches:
            for terms, starts in zip(b.column(0), b.column(1), strict=True):
                at = block.places(terms.values)
                total[at >= 0] += np.diff(np.frombuffer(starts.as_py(), "<i8"))[at[at >= 0]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["code", "df"])

    rows = index.shards.select("terms", "starts").mapInArrow(run, "code long, df long")
    return {r.code: r.df for r in rows.groupBy("code").agg(F.sum("df").alias("df")).collect()}


def best_of(scores: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores above 0; of equal ones the first places."""
    some = np.flatnonzero(scores)
    if len(some) <= top:
        return some
    values = scores[some]
    least = values[np.argpartition(values, -top)[-top:]].min()
    over = values > least
    return np.concatenate((some[over], some[values == least][: top - int(over.sum())]))


def shard_scores(index: Index, sent, weights: np.ndarray, top: int, kind: str) -> DataFrame:
    """(k, doc_id, score): the best rows of each query of a block in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for b in batches:
            for ids, terms, *blobs in zip(*b.columns, strict=True):
                at = block.places(terms.values)
                starts, docs, impacts = (np.frombuffer(x.as_py(), t) for x, t in zip(blobs, ("<i8", "<i4", "<i4"), strict=True))
                keys, places, found = [], [], []
                for i, key in enumerate(block.keys):
                    scores = np.zeros(len(ids.values), np.int64)
                    for j in range(block.starts[i], block.starts[i + 1]):
                        code = block.codes[j]
                        if at[code] >= 0:
                            part = slice(starts[at[code]], starts[at[code] + 1])
                            scores[docs[part]] += weights[code] * block.times[j] * impacts[part].astype(np.int64)
                    best = best_of(scores, top)
                    keys.append(np.full(len(best), key))
                    places.append(best)
                    found.append(scores[best])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys), pa.int64()), ids.values.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(found), pa.int64())],
                    ["k", "doc_id", "score"],
                )

    return index.shards.mapInArrow(run, f"k long, doc_id {kind}, score long")


def search(index: Index, queries: DataFrame, top: int = 20, block_terms: int = BLOCK_TERMS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, rank, doc_id, score): the ``top`` documents of each query, over all documents.

    A term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))); a score is the sum
    of w times impact over a query's terms with their repeats. Queries go to
    the executors in blocks of about ``block_terms`` distinct terms, of which
    a longer query is one; each block reads the index, not the texts, twice.
    Each shard gives its best rows to one of ``MERGERS`` merges, and these give
    theirs to the last, so no task gets rows of all shards.

    Defined cases: a query without terms (null, empty) has no rows; equal
    scores go by ascending doc_id, null ids first; each row of ``queries`` is a
    query, so repeated ones give repeated rows, and repeated documents take a
    rank each; empty tables give no rows; other columns are ignored; texts of
    any length are read whole.
    """
    spark = queries.sparkSession
    kind = index.shards.schema["ids"].dataType.elementType.simpleString()
    asked = materialise(queries.select(F.monotonically_increasing_id().alias("k"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "queries")
    parts = []
    for block in query_blocks(asked, block_terms):
        sent = spark.sparkContext.broadcast(block)
        weights = np.zeros(len(block.terms), np.int64)
        for code, df in document_counts(index, sent).items():
            weights[code] = floor(1000 * log((2 * index.n_docs + 2) / (2 * df + 1)))
        parts.append(materialise(shard_scores(index, sent, weights, top, kind), "shard-scores"))
        sent.unpersist()
    if not parts:
        parts = [spark.createDataFrame([], f"k long, doc_id {kind}, score long")]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)

    def ranked(rows: DataFrame, *group: str) -> DataFrame:
        order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc("doc_id"))
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    merged = ranked(found.withColumn("merger", F.spark_partition_id() % MERGERS), "k", "merger")
    return ranked(merged, "k").join(asked.select("k", "id"), "k").select(F.col("id").alias(id_col), "rank", "doc_id", "score")
