"""License notices: phrase places, and an exact containment join against templates."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_list

PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices in our own short wording; a label may have several.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("proprietary", "all rights reserved no part may be reproduced without written permission"),
]


class TemplateIndex:
    """Prefix index of templates for exact containment joins.

    Tokens are ordered by how many documents hold them, rarest first. A block
    B meets template T when |T and B| >= need(T) = ceil(threshold * |T|), so
    one of the first |T| - need + 1 tokens of T in that order must lie in B
    (prefix filter); B needs at least need tokens (length filter); and a first
    common token at place p leaves at most |T| - p common ones (positional
    filter, which bounds p and ends the count early).
    """

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        self.entries: list[tuple[str, list[bytes], int]] = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for label, text in templates:
            tokens = sorted(set(word_list(text.encode())), key=lambda w: (frequency.get(w, 0), w))
            if not tokens:
                continue
            need = max(1, ceil(threshold * len(tokens) - 1e-9))
            for p in range(len(tokens) - need + 1):
                self.prefix.setdefault(tokens[p], []).append((len(self.entries), p))
            self.entries.append((label, tokens, need))
        self.span = max((len(word_list(t.encode())) for _, t in templates), default=0)

    def search(self, block: set[bytes]) -> Iterator[tuple[str, float]]:
        """(label, containment) of every template that ``block`` meets."""
        for entry, share in self.entries_met(block):
            yield self.entries[entry][0], share

    def entries_met(self, block: set[bytes]) -> Iterator[tuple[int, float]]:
        """(number, containment) of every template that ``block`` meets."""
        first: dict[int, int] = {}
        for w in self.prefix.keys() & block:
            for entry, p in self.prefix[w]:
                first[entry] = min(p, first.get(entry, p))
        for entry, p in first.items():
            _, tokens, need = self.entries[entry]
            if len(block) < need:
                continue
            common = 0
            for i in range(p, len(tokens)):
                if common + len(tokens) - i < need:
                    break
                common += tokens[i] in block
            if common >= need:
                yield entry, common / len(tokens)

    def search_windows(self, words: list[bytes], present: set[bytes]) -> Iterator[tuple[str, float]]:
        """(label, best containment) of every template that ``span`` words in a row meet.

        A template is looked for only if all words together meet it. Its tokens'
        places are passed once, with those less than ``span`` apart in hand.
        """
        met = [entry for entry, _ in self.entries_met(present)]
        if not met:
            return
        wanted = set().union(*(self.entries[entry][1] for entry in met))
        found = [(i, w) for i, w in enumerate(words) if w in wanted]
        for entry in met:
            label, tokens, need = self.entries[entry]
            inside, count, best, back = set(tokens), {}, 0, 0
            own = [x for x in found if x[1] in inside]
            for i, w in own:
                count[w] = count.get(w, 0) + 1
                while own[back][0] <= i - self.span:
                    gone = own[back][1]
                    count[gone] -= 1
                    if not count[gone]:
                        del count[gone]
                    back += 1
                best = max(best, len(count))
            if best >= need:
                yield label, best / len(tokens)


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Starts of the places where the words of ``phrase`` stand consecutively."""
    found, n, at = [], len(phrase), -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return found
        if words[at : at + n] == phrase:
            found.append(at)


def token_frequency(docs: DataFrame, tokens: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How many documents hold each of ``tokens``, over all of ``docs``.

    Counts are combined in each task; the driver gets a row a token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = dict.fromkeys(tokens, 0)
        for b in batches:
            for value in b.column(0):
                for w in tokens.intersection(word_list(value.as_py())):
                    count[w] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["w", "n"]
        )

    parts = docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "w binary, n long")
    return {bytes(r.w): r.n for r in parts.groupBy("w").agg(F.sum("n").alias("n")).collect()}


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    templates: list[tuple[str, str]] | None = None,
    threshold: float = 0.9,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Phrase places and template labels of every document.

    Columns: id, n_words, n_base, first_word, last_word, base_labels (array),
    labels (array: those of phrases and of templates), score (best containment
    of a template that a block of the text meets, 1 where a phrase stands,
    else 0). Blocks of the join are the lines of the text, and all runs of as
    many words as the longest template has, across lines: notices are often
    wrapped. Templates are a parameter and few; the index holds their tokens only.

    Defined cases: null and empty texts have no words, no label and score 0;
    long lines are one block; repeated rows are scanned one by one; null ids
    pass through; an empty table gives no rows; other columns are ignored.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    tokens = {w for _, t in templates for w in word_list(t.encode())}
    index = TemplateIndex(templates, token_frequency(docs, tokens, text_col), threshold)
    sent = docs.sparkSession.sparkContext.broadcast((index, [(word_list(p.encode()), v) for p, v in phrases.items()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, phrases = sent.value
        telling = set(index.prefix)
        rare = {p[0] if len(p) == 1 else max(p, key=len): 0 for p, _ in phrases}
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for value in b.column(1):
                text = value.as_py() or b""
                words = word_list(text)
                starts, base, labels, score = [], set(), set(), 0.0
                present = set(words)
                if not rare.keys().isdisjoint(present):
                    for phrase, label in phrases:
                        if found := places(words, phrase) if present.issuperset(phrase) else []:
                            starts += found
                            base.add(label)
                            score = 1.0
                if not telling.isdisjoint(present):
                    for label, share in index.search_windows(words, present):
                        labels.add(label)
                        score = max(score, share)
                    for line in text.split(b"\n"):
                        block = set(word_list(line))
                        if not telling.isdisjoint(block):
                            for label, share in index.search(block):
                                labels.add(label)
                                score = max(score, share)
                for column, x in zip(
                    out,
                    (len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(base), sorted(base | labels), score),
                    strict=True,
                ):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
                ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return (
        docs.select(F.col(id_col), F.col(text_col).cast("binary"))
        .mapInArrow(
            run,
            f"id {kind}, n_words long, n_base long, first_word long, last_word long,"
            " base_labels array<string>, labels array<string>, score double",
        )
        .withColumnRenamed("id", id_col)
    )
