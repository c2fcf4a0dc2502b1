"""A store of Parquet tables: appended logs, and snapshots that are swapped in one step."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables below one folder of shared storage.

    A log is a folder that is appended to. A snapshot is a folder of versions;
    readers take the newest one that was written to its end, so a replacement
    shows at once or not at all, and a writer that dies leaves nothing behind
    that is read. One writer a table is assumed, as for any Parquet folder.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        files, at = self._files(path)
        return files.exists(at)

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{name}")

    def log(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], schema)

    def versions(self, name: str) -> list[int]:
        files, at = self._files(f"{self.folder}/{name}")
        if not files.exists(at):
            return []
        kept = [s.getPath() for s in files.listStatus(at) if s.getPath().getName().startswith("v")]
        return sorted(int(p.getName()[1:]) for p in kept if self._exists(f"{p.toString()}/_SUCCESS"))

    def replace(self, name: str, rows: DataFrame, keep: int = 2) -> int:
        """Writes a new version beside the others, moves it to its name, and deletes all but ``keep``."""
        before = self.versions(name)
        new = (before[-1] if before else 0) + 1
        draft, final = f"{self.folder}/{name}/draft-{uuid.uuid4().hex}", f"{self.folder}/{name}/v{new}"
        rows.write.parquet(draft)
        files, source = self._files(draft)
        if not files.rename(source, self._files(final)[1]):
            raise OSError(f"{final} was written meanwhile")
        for old in before[: max(0, len(before) + 1 - keep)]:
            files.delete(self._files(f"{self.folder}/{name}/v{old}")[1], True)
        return new

    def snapshot(self, name: str, schema: str) -> DataFrame:
        found = self.versions(name)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/v{found[-1]}") if found else self.spark.createDataFrame([], schema)

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """New snapshots of several tables that show at once or not at all.

        All are written first; one small file that names their versions then takes
        its place, and ``at`` reads the tables as the newest such file tells.
        """
        names = sorted(tables)
        number = max(self._commits(), default=0) + 1
        lines = [f"{name}={self.replace(name, tables[name], keep=1 << 30)}" for name in names]
        before = dict(x.split("=") for x in self._commit(number - 1)) if number > 1 else {}
        told = {**before, **dict(x.split("=") for x in lines)}
        draft = f"{self.folder}/commits/draft-{uuid.uuid4().hex}"
        files, source = self._files(draft)
        out = files.create(source)
        try:
            out.writeUTF("\n".join(f"{k}={v}" for k, v in sorted(told.items())))
        finally:
            out.close()
        if not files.rename(source, self._files(f"{self.folder}/commits/c{number}")[1]):
            raise OSError(f"commit {number} was made meanwhile")
        return number

    def _commits(self) -> list[int]:
        files, at = self._files(f"{self.folder}/commits")
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        return sorted(int(n[1:]) for n in names if n.startswith("c"))

    def _commit(self, number: int) -> list[str]:
        files, at = self._files(f"{self.folder}/commits/c{number}")
        stream = files.open(at)
        try:
            return stream.readUTF().split("\n")
        finally:
            stream.close()

    def at(self, name: str, schema: str, number: int | None = None) -> DataFrame:
        """A table as of a commit, the newest one where none is named."""
        known = self._commits()
        number = number if number is not None else (known[-1] if known else 0)
        versions = dict(x.split("=") for x in self._commit(number)) if number else {}
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/v{versions[name]}") if name in versions else self.spark.createDataFrame([], schema)

    def update(self, name: str, schema: str, change: Callable[[DataFrame], DataFrame]) -> int:
        """A snapshot after ``change``, as one transaction."""
        return self.replace(name, change(self.snapshot(name, schema)))


def changed(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with the non-null values of ``updates`` in their place: a partial update by key.

    Of several updates of a key the last by ``updated_at`` holds, column by column.
    """
    last = updates.groupBy(F.col(key).alias("__key")).agg(
        *(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("updated_at"))).alias(f"__{c}") for c in columns), F.max("updated_at").alias("__at")
    )
    found = rows.join(last, F.col(key) == F.col("__key"), "left")
    new = {c: F.coalesce(f"__{c}", c) for c in columns}
    if "updated_at" in rows.columns:
        new["updated_at"] = F.coalesce("__at", "updated_at")
    return found.select(*(new[c].alias(c) if c in new else F.col(c) for c in rows.columns))


def without(tables: dict[str, DataFrame], parents: dict[str, tuple[str, str]], gone: DataFrame, root: str, key: str = "id") -> dict[str, DataFrame]:
    """All tables after rows of ``root`` are deleted: children of deleted rows go too.

    ``parents`` gives (parent table, foreign key) of each child; a child may be a
    parent itself. ``gone(id)`` names the deleted rows of ``root``.
    """
    lost, left = {root: gone.select(F.col(key).alias("__gone")).distinct()}, dict(tables)
    left[root] = tables[root].join(lost[root], F.col(key) == F.col("__gone"), "left_anti")
    waiting = dict(parents)
    while waiting:
        ready = [c for c, (p, _) in waiting.items() if p in lost]
        if not ready:
            break
        for child in ready:
            parent, foreign = waiting.pop(child)
            rows = tables[child]
            lost[child] = rows.join(lost[parent], F.col(foreign) == F.col("__gone"), "left_semi")
            left[child] = rows.join(lost[parent], F.col(foreign) == F.col("__gone"), "left_anti")
            lost[child] = lost[child].select(F.col(key).alias("__gone")) if key in rows.columns else lost[child].limit(0).select(F.lit(None).cast("string").alias("__gone"))
    return left
