"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import materialise, word_list

BITS = 22
FOUND = ["n_words", "n_hit", "items", "contaminated", "spans", "clean_text"]
FOUND_SCHEMA = (
    "n_words long, n_hit long, items array<string>, contaminated boolean, spans array<array<long>>, clean_text string"
)


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the windows of each item.

    ``length``, ``link`` and ``to`` are the usual arrays. ``windows[v]`` lists
    (window length, items) for the windows whose state is ``v``; ``above[v]``
    is the nearest state on the suffix links, ``v`` included, that has any.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.width = width
        self.ids: dict[bytes, int] = {}
        self.length, self.link, self.to = [0], [-1], [{}]
        words = [(name, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for name, ws in items]
        for _, ws in words:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.windows: list[dict[int, list[str]] | None] = [None] * len(self.length)
        self.pairs = np.zeros(1 << BITS, bool)
        self.shortest = width
        for name, ws in words:
            n = min(width, len(ws))
            if not n:
                continue
            self.shortest = min(self.shortest, n)
            known = np.array(ws, np.int64)
            self.pairs[self.code(known)] = True
            state = 0
            for i, w in enumerate(ws):
                state = self.to[state][w]
                while self.length[self.link[state]] >= n:
                    state = self.link[state]
                if i + 1 >= n:
                    at = self.windows[state] = self.windows[state] or {}
                    names = at.setdefault(n, [])
                    if not names or names[-1] != name:
                        names.append(name)
        self.above = [-1] * len(self.length)
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.above[v] = v if self.windows[v] else self.above[self.link[v]]

    def _extend(self, last: int, w: int) -> int:
        length, link, to = self.length, self.link, self.to
        if w in to[last]:
            q = to[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        to.append({})
        p = last
        while p >= 0 and w not in to[p]:
            to[p][w] = new
            p = link[p]
        if p >= 0:
            q = to[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.to.append(dict(self.to[q]))
        while p >= 0 and self.to[p].get(w) == q:
            self.to[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    @staticmethod
    def code(ids: np.ndarray) -> np.ndarray:
        """Table places of adjacent pairs of word ids."""
        return ((ids[:-1] * 1_000_003) ^ ids[1:]) & ((1 << BITS) - 1)

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches [i, j) of known words and known adjacent pairs that can hold a window."""
        if self.shortest <= 1:
            yield 0, len(ids)
            return
        linked = self.pairs[self.code(ids)] & (ids[:-1] >= 0) & (ids[1:] >= 0)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], linked.view(np.int8), [0]))))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if j - i + 1 >= self.shortest:
                yield i, j + 1

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Marks of the words inside occurrences of windows; the items with an occurrence."""
        hit, found, get = np.zeros(len(words), bool), set(), self.ids.get
        if len(words) < self.shortest or not self.ids:
            return hit, found
        ids = np.array([get(w, -1) for w in words], np.int64)
        for i, j in self.candidates(ids):
            state = matched = 0
            for at, w in enumerate(ids[i:j].tolist(), i):
                while state and w not in self.to[state]:
                    state = self.link[state]
                    matched = self.length[state]
                state = self.to[state].get(w, 0)
                if not state:
                    matched = 0
                    continue
                matched += 1
                v = self.above[state]
                while v > 0:
                    for n, names in self.windows[v].items():
                        if n <= matched:
                            hit[at + 1 - n : at + 1] = True
                            found.update(names)
                    v = self.above[self.link[v]]
        return hit, found


def benchmark_blocks(
    benchmark: DataFrame, block_words: int, id_col: str = "item_id", text_col: str = "text"
) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items as (id, words), in blocks of about ``block_words`` words, ordered by id."""
    block, size = [], 0
    rows = benchmark.select(
        F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")
    ).where("i is not null").orderBy("i", "t")
    for row in rows.toLocalIterator():
        words = word_list(bytes(row.t) if row.t is not None else None)
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row.i, words))
        size += len(words)
    if block:
        yield block


SPANS = "array<array<long>>"
BROADCAST_ROWS = 500_000


def spans_of(hit: np.ndarray) -> list[list[int]]:
    """[first, last + 1] of each run of marks."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
    return [edges[i : i + 2] for i in range(0, len(edges), 2)]


def block_hits(docs: DataFrame, block: list[tuple[str, list[bytes]]], width: int) -> DataFrame:
    """(k, l, spans, items) of the rows of (k, l, text) in which one block of items has an occurrence."""
    sent = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(block, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value
        for b in batches:
            rows = []
            for k, l, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                hit, found = automaton.scan(word_list(text))
                if found:
                    rows.append({"k": k, "l": l, "spans": spans_of(hit), "items": sorted(found)})
            yield pa.RecordBatch.from_pylist(rows, HITS)

    found = materialise(docs.mapInArrow(run, f"k long, l long, spans {SPANS}, items array<string>").dropDuplicates(["k", "l"]), "block-hits")
    sent.destroy()
    return found


HITS = pa.schema([("k", pa.int64()), ("l", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 13,
    share: float = 0.05,
    block_words: int = 250_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    remove_spans: bool = False,
    carry: bool = False,
) -> DataFrame:
    """One row a document: words, hit words, items found, verdict and hit spans.

    A window is ``width`` consecutive words of an item, or the whole of a
    shorter item. Items go into blocks of about ``block_words`` words (a
    longer item is a block of its own), and documents stream past one block's
    automaton at a time: a worker and the driver hold one, of about 800 bytes
    a word, so 200 MB. One block takes one pass; with more, each pass writes
    down the hits of the documents that have any, and a last one unites them.
    The automaton walks only stretches of adjacent word pairs that occur in
    the benchmark; elsewhere no window can lie.

    Columns: id, n_words, n_hit, items (sorted strings), contaminated (n_hit
    is over 0 and at least ``share`` of the words), spans (array of
    [first word, last word + 1]), and with ``remove_spans`` ``clean_text``:
    the text without its hit words and what stands between them. With
    ``carry`` the other columns of ``docs`` travel along, and two underscores
    go before the names above.

    Defined cases: null or empty texts have no words and are clean; items
    without words or ids match nothing; an empty benchmark leaves every
    document clean; repeated rows are judged one by one; null ids pass through;
    columns other than id and text are ignored.
    """
    spark = docs.sparkSession
    extra = [c for c in docs.columns if c not in (id_col, text_col)] if carry else []
    text = F.col(text_col).cast("binary")
    key = [F.xxhash64(text).alias("k"), F.xxhash64(F.lit(1), text).alias("l")]
    rows = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), *key, *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(extra))
    )
    blocks = benchmark_blocks(benchmark, block_words)
    first, second = next(blocks, []), next(blocks, None)
    none = [F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<array<string>>").alias("items")]
    sent = None
    if second is None:
        sent = spark.sparkContext.broadcast(SuffixAutomaton(first, width))
        rows = rows.select("*", *none)
    else:
        texts = rows.select("k", "l", "text")
        hits = block_hits(texts, first, width)
        for block in chain([second], blocks):
            hits = hits.unionByName(block_hits(texts, block, width))
        # texts that are equal have equal hits
        hits = hits.groupBy("k", "l").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.collect_list("items").alias("items"))
        hits = materialise(hits, "hits")
        rows = rows.join(F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits, ["k", "l"], "left")
    percent = round(share * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for value, given, items in zip(b.column(1), b.column(2), b.column(3), strict=True):
                text = value.as_py()
                words = word_list(text)
                if sent is not None:
                    hit, found = sent.value.scan(words)
                else:
                    hit = np.zeros(len(words), bool)
                    for i, j in given.as_py() or ():
                        hit[i:j] = True
                    found = {x for xs in items.as_py() or () for x in xs}
                n_hit = int(hit.sum())
                spans = spans_of(hit)
                clean = None
                if remove_spans and text is not None:
                    clean = without_words(text, spans) if spans else text
                contaminated = n_hit > 0 and 100 * n_hit >= percent * len(words)
                row = (
                    len(words), n_hit, sorted(found), contaminated, spans,
                    None if clean is None else clean.decode("utf-8", "replace"),
                )
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [
                pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.list_(pa.list_(pa.int64())), pa.string(),
            ]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *arrays, *b.columns[4:]], ["id", *FOUND, *(f"c{i}" for i in range(len(extra)))]
            )

    source = rows.select("id", "text", "spans", "items", *(f"c{i}" for i in range(len(extra))))
    schema = StructType([source.schema["id"], *_parse_datatype_string(FOUND_SCHEMA), *source.schema[4:]])
    result = source.mapInArrow(run, schema)
    names = [f"__{n}" for n in FOUND] if carry else FOUND
    result = result.toDF(id_col, *names, *extra)
    return result if remove_spans else result.drop(names[-1])


def without_words(text: bytes, spans: list[list[int]]) -> bytes:
    """``text`` without words i to j-1 of each span [i, j) and what stands between them."""
    import re

    places = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]
    kept, at = [], 0
    for i, j in spans:
        kept.append(text[at : places[i][0]])
        at = places[j - 1][1]
    return b"".join([*kept, text[at:]])
