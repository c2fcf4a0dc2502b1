"""Stored responses as a data source of Spark: numbered batches of writing, in them a folder for each host.

    spark.dataSource.register(StoredResponses)
    spark.read.format("stored_responses").load(folder)
    spark.readStream.format("stored_responses").load(folder)

Another way to get pages, such as a browser's renderings, is another source with
these columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from tessera.sources.sheets import PAGE_BYTES

SCHEMA = "host string, url string, status int, content_type string, body string"
COLUMNS = ["url", "status", "content_type", "body"]
FILE_ROWS = 5_000
PIECE_BYTES = 128 << 20


@dataclass
class Piece(InputPartition):
    """Files of one host, or of several, that one task reads."""

    files: list[tuple[str, str]]  # (host, path)


def address(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def stored_batches(folder: str) -> list[int]:
    """Numbers of the batches that were written to their ends."""
    files, root = pafs.FileSystem.from_uri(address(folder))
    found = [x for x in files.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.base_name.startswith("batch=")]
    done = files.get_file_info([f"{x.path}/_SUCCESS" for x in found]) if found else []
    return sorted(int(x.base_name.removeprefix("batch=")) for x, mark in zip(found, done, strict=True) if mark.is_file)


def stored_files(folder: str, batches: list[int], hosts: set[str] | None = None) -> list[tuple[str, str, int]]:
    """(host, path, bytes) of the files of batches, of ``hosts`` only; other hosts' folders are not listed."""
    files, root = pafs.FileSystem.from_uri(address(folder))
    found = []
    for number in batches:
        for part in files.get_file_info(pafs.FileSelector(f"{root}/batch={number}")):
            host = unquote(part.base_name.removeprefix("host="))
            if part.base_name.startswith("host=") and (hosts is None or host in hosts):
                found += [(host, x.path, x.size) for x in files.get_file_info(pafs.FileSelector(part.path)) if x.extension == "parquet"]
    return found


def pieces(found: list[tuple[str, str, int]], most_bytes: int) -> list[Piece]:
    """Files dealt to tasks of about ``most_bytes``."""
    out: list[Piece] = []
    size = most_bytes
    for host, path, n in found:
        if size >= most_bytes:
            out.append(Piece([]))
            size = 0
        out[-1].files.append((host, path))
        size += n
    return out or [Piece([])]


def read_piece(folder: str, piece: Piece) -> Iterator[pa.RecordBatch]:
    files, _ = pafs.FileSystem.from_uri(address(folder))
    for host, path in piece.files:
        with files.open_input_file(path) as handle:
            for batch in pq.ParquetFile(handle).iter_batches(batch_size=256, columns=COLUMNS):
                yield pa.RecordBatch.from_arrays([pa.array([host] * batch.num_rows, pa.string()), *batch.columns], ["host", *COLUMNS])


class StoredResponses(DataSource):
    """``folder`` holds what ``write_responses`` wrote; the option ``pieceBytes`` sets what a task reads (128 MB).

    With ``spark.sql.python.filterPushdown.enabled`` a filter on ``host`` (equal
    to a value, or in a list) reads the folders of those hosts only. As a
    stream, batches of writing come in their order, ``batchesPerTrigger`` of them
    at a time (100); its offset is the number of the last one, so a restart goes on
    behind it. Files are opened with Arrow, so the folder must lie where its
    file systems reach.
    """

    @classmethod
    def name(cls) -> str:
        return "stored_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ResponseReader(self.options["path"], int(self.options.get("pieceBytes", PIECE_BYTES)))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return ResponseStream(self.options["path"], int(self.options.get("pieceBytes", PIECE_BYTES)), int(self.options.get("batchesPerTrigger", 100)))


class ResponseReader(DataSourceReader):
    def __init__(self, folder: str, most_bytes: int):
        self.folder, self.most_bytes = folder, most_bytes
        self.hosts: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("host",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.hosts = wanted if self.hosts is None else self.hosts & wanted
            else:
                yield f

    def partitions(self) -> list[Piece]:
        return pieces(stored_files(self.folder, stored_batches(self.folder), self.hosts), self.most_bytes)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return read_piece(self.folder, partition)


class ResponseStream(DataSourceStreamReader):
    def __init__(self, folder: str, most_bytes: int, most_batches: int):
        self.folder, self.most_bytes, self.most_batches = folder, most_bytes, most_batches
        self.reached = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"batch": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """The last of the next batches; Spark asks once before each of its own."""
        new = [n for n in stored_batches(self.folder) if n > self.reached][: self.most_batches]
        self.reached = new[-1] if new else self.reached
        return {"batch": self.reached}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.reached = max(self.reached, end["batch"])
        batches = [n for n in stored_batches(self.folder) if start["batch"] < n <= end["batch"]]
        return pieces(stored_files(self.folder, batches), self.most_bytes)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return read_piece(self.folder, partition)


def write_responses(responses: DataFrame, folder: str, most_bytes: int = PAGE_BYTES) -> int:
    """Stores ``responses(url, status, content_type, body)`` as the next batch and returns its number.

    Bodies over ``most_bytes`` are left out, as a fetch leaves them, and so are
    urls without a host. Spark's writer commits the batch as one, so tasks may
    be repeated, and readers see it when it is whole. One job writes at a time.
    """
    host = F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    rows = responses.where(F.coalesce(F.octet_length("body"), F.lit(0)) <= most_bytes)
    rows = rows.select(host.alias("host"), "url", F.col("status").cast("int").alias("status"), "content_type", "body").where("host <> ''")
    number = max(stored_batches(folder), default=0) + 1
    # a batch that was cut short goes
    rows.write.partitionBy("host").option("maxRecordsPerFile", FILE_ROWS).mode("overwrite").parquet(f"{address(folder)}/batch={number}")
    return number
