"""Sum-of-squares online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
    " sequence_id long, offset long"
)


def _classes(low: int, high: int) -> tuple[str, str]:
    """Regex classes of the letters and of the numbers in a range of code points."""
    of = {"L": [], "N": []}
    for point in range(low, high):
        kind = unicodedata.category(chr(point))[0]
        if kind in of:
            of[kind].append(re.escape(chr(point)))
    return "".join(of["L"]), "".join(of["N"])


# the settings under which no token crosses white space and a chunk is cut into words, digits and signs
BY_CHUNKS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split", "behavior": "Removed", "invert": True,
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def goes_by_chunks(path: str) -> bool:
    """Whether a tokenizer's own settings are those that the chunk tables stand for."""
    with open(path, encoding="utf-8") as f:
        settings = json.load(f)
    extras = [settings.get(k) for k in ("post_processor", "truncation", "padding")]
    model = settings["model"]
    plain = model.get("type") == "BPE" and not model.get("dropout") and model.get("end_of_word_suffix") == "</w>"
    return plain and not any(extras) and all(settings.get(k) == v for k, v in BY_CHUNKS.items())


class WordEncoder:
    """Ids of a tokenizer, looked up by white-space chunk where its settings allow it.

    For the settings ``BY_CHUNKS`` a chunk's ids are those it has anywhere;
    they are kept in a bounded table. Texts with characters outside plain
    Latin ranges, or with markers of special tokens, and all texts of other
    tokenizers go to the library whole.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_chunks = goes_by_chunks(path)
        self.most = most
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        letters, numbers = _classes(0x21, 0x250)
        self.split = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+"
        ).findall
        # U+0130 lower-cases to two characters; soft hyphen and C1 controls stay with the library
        self.other = re.compile(
            "[^\t\n\r\x20-\x7e¡-¬®-įı-ɏ"
            "‐-‧‰-⁞€]|<\\|"
        ).search
        # the byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.byte = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= self.most:
                self.parts.clear()
            spelled = part if part.isascii() else "".join(map(self.byte.__getitem__, part.encode()))
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()
            self.parts[part] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():  # a single part already
            return self._part(chunk)
        ids = b"".join(map(self._part, self.split(chunk)))
        if len(chunk) <= 64:
            if len(self.chunks) >= self.most:
                self.chunks.clear()
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids, without special tokens of a template."""
        if not text:
            return b""
        if not self.by_chunks or self.other(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        part, chunk, make = self.parts.get, self.chunks.get, self._chunk
        # no chunk is without ids, so `or` finds the misses
        return b"".join([part(c) or chunk(c) or make(c) for c in text.lower().split()])


@lru_cache(maxsize=1)
def encoder_for(path: str) -> WordEncoder:
    """One encoder a worker process, so that its tables serve the process's later tasks."""
    return WordEncoder(path)


class SquareSumPacker:
    """Online placement of documents into windows of ``size`` ids.

    ``levels[h]`` counts the open windows filled to ``h``. A document goes to
    the level where the sum of squared counts becomes least (ties: the fullest
    window). What is longer than a window is cut into whole windows first. A
    window left with a gap under ``gap`` ids, and the fullest one when more
    than ``most_open`` are open, is topped up from the start of the next
    documents, so it closes without padding. ``finish`` joins what is still
    open end to end, which leaves at most one window that is not full.
    """

    def __init__(self, size: int = 4096, gap: int = 256, most_open: int = 512):
        self.size, self.gap, self.most_open = size, gap, most_open
        self.levels = np.zeros(size + 1, np.int64)
        self.windows: dict[int, list[list]] = {}
        self.short: list[list] = []  # windows to be topped up; each a list of pieces
        self.open = 0
        self.next = 0

    def _emit(self, pieces: list) -> Iterator[tuple]:
        number, self.next, at = self.next, self.next + 1, 0
        for doc, start, ids, tokens in pieces:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), tokens, number, at
            at += n

    def _level(self, n: int) -> int:
        """The fill level, 0 for a new window, that an item of ``n`` ids goes to."""
        top = self.size - n
        counts = self.levels[1 : top + 1]
        if not counts.any():
            return 0
        cost = self.levels[1 + n : self.size + 1] - counts + 1.0
        cost[-1] = 0.5 - counts[-1]  # a full window is no longer counted
        cost[counts == 0] = np.inf
        best = top - 1 - int(np.argmin(cost[::-1]))
        return best + 1 if cost[best] <= self.levels[n] + 0.5 else 0

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        tokens, start = len(ids) // 4, 0
        while self.short and start < tokens:
            window = self.short[-1]
            n = min(self.size - window[0], tokens - start)
            window[1].append((doc, start, ids[4 * start : 4 * (start + n)], tokens))
            window[0] += n
            start += n
            if window[0] == self.size:
                yield from self._emit(self.short.pop()[1])
        while tokens - start >= self.size:
            yield from self._emit([(doc, start, ids[4 * start : 4 * (start + self.size)], tokens)])
            start += self.size
        if start == tokens:
            return
        n = tokens - start
        level = self._level(n)
        if level:
            pieces = self.windows[level].pop()
            self.levels[level] -= 1
            self.open -= 1
        else:
            pieces = []
        pieces.append((doc, start, ids[4 * start :], tokens))
        level += n
        if level == self.size:
            yield from self._emit(pieces)
        elif level > self.size - self.gap:
            self.short.append([level, pieces])
        else:
            self.windows.setdefault(level, []).append(pieces)
            self.levels[level] += 1
            self.open += 1
            if self.open > self.most_open:
                fullest = int(np.flatnonzero(self.levels)[-1])
                self.levels[fullest] -= 1
                self.open -= 1
                self.short.append([fullest, self.windows[fullest].pop()])

    def finish(self) -> Iterator[tuple]:
        left = [p for _, pieces in self.short for p in pieces]
        left += [p for level in sorted(self.windows, reverse=True) for w in self.windows[level] for p in w]
        window, room = [], self.size
        for doc, start, ids, tokens in left:
            while ids:
                n = min(room, len(ids) // 4)
                window.append((doc, start, ids[: 4 * n], tokens))
                ids, start, room = ids[4 * n :], start + n, room - n
                if not room:
                    yield from self._emit(window)
                    window, room = [], self.size
        if window:
            yield from self._emit(window)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    size: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    gap: int = 256,
    most_open: int = 512,
) -> DataFrame:
    """Cut all documents into pieces and place the pieces into windows of ``size`` ids.

    One packer runs per input partition, so nothing is shuffled and a lost
    executor costs its partitions again; ``sequence_id`` holds the partition
    number above bit 40. Memory holds the open windows (``most_open`` at most,
    each under ``size`` ids), the vocabulary and a bounded table of words.

    ``tokenizer`` is a file name known to ``public_tokenizers`` or a path, of
    a JSON file of the tokenizers library with any settings.

    Defined cases: a null or empty text is the single id ``end_id``; a long
    text is cut into as many windows as it needs; repeated rows and null ids
    are packed like any other row; an empty table gives no rows; other columns
    of ``docs`` are ignored. At most one window a partition is not full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        path = tokenizer
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        encoder, packer = encoder_for(path), SquareSumPacker(size, gap, most_open)
        first = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4").tobytes()
        kinds = [pa.int64()] * 7
        names = [c.split()[0] for c in PIECES.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            columns[5] = [first + n for n in columns[5]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

        rows: list[tuple] = []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows.extend(packer.add(doc, encoder.encode(text.as_py()) + end))
                if len(rows) >= 20_000:
                    yield batch(rows)
                    rows = []
        rows.extend(packer.finish())
        if rows:
            yield batch(rows)

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, PIECES)
