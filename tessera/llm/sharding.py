"""Byte-balanced shards by sampled splitters over a key range."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, unsigned_crc32

ROWS_A_RANGE, MOST_RANGES, MOST_SAMPLES = 1_000_000, 65_536, 2_000_000


def composite_key() -> Column:
    """Both hashes as hexadecimal digits, which order like a pair of unsigned numbers."""
    return F.concat(F.lpad(F.hex("text_key"), 16, "0"), F.lpad(F.hex("id_key"), 16, "0"))


def _range_of(splitters: list[str]) -> Column:
    """The number of splitters at or under the row's key.

    The key's first byte picks the few splitters to compare with; the others
    are counted beforehand. Both tables are literals.
    """
    groups: list[list[str]] = [[] for _ in range(256)]
    for s in splitters:
        groups[int(s[:2], 16)].append(s)
    before = [0, *accumulate(map(len, groups))]
    top = F.shiftrightunsigned("text_key", 56).cast("int")
    mine = F.split(F.get(F.split(F.lit(";".join(map(",".join, groups))), ";"), top), ",")
    key = F.col("key")
    return (F.get(_longs(before), top) + F.size(F.filter(mine, lambda s: (s != "") & (s <= key)))).cast("int")


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _unit(*seed: int) -> Column:
    """A repeatable number in [0, 1) for each row."""
    return F.pmod(F.xxhash64("id_key", "text_key", *map(F.lit, seed)), F.lit(1 << 53)) / float(1 << 53)


def find_splitters(
    rows: DataFrame, total: int, ranges: int, per_range: int = 32, rounds: int = 4
) -> tuple[list[str], list[tuple[int, int]]]:
    """Splitters that cut ``rows`` into ranges of about ``total / ranges`` bytes,
    and the (bytes, rows) of each range.

    Each row enters the sample with a chance in proportion to its size, so
    every sampled key stands for equally many bytes; about ``ranges *
    per_range`` keys come to the driver. A range of over one and a half times
    its due is sampled again by itself and subdivided. Rows that agree in text
    and id cannot be told apart and stay in one range.
    """
    due = total / ranges
    splitters: list[str] = []
    over = rows
    for turn in range(rounds):
        sample = over.where(_unit(turn) < F.col("size") * per_range / due)
        keys = sorted(r.key for r in sample.select("key").collect())
        splitters = sorted({*splitters, *keys[per_range - 1 :: per_range]})
        numbered = rows.withColumn("range", _range_of(splitters))
        sizes = numbered.groupBy("range").agg(
            F.sum("size").alias("n"), F.count("*").alias("rows"),
            F.max("text_key").alias("a"), F.min("text_key").alias("b"), F.max("id_key").alias("c"), F.min("id_key").alias("d"),
        ).collect()
        wide = [r.range for r in sizes if r.n > 1.5 * due and (r.a, r.c) != (r.b, r.d)]
        if not wide:
            break
        over = numbered.where(F.col("range").isin(wide))
    found = {r.range: (r.n, r.rows) for r in sizes}
    return splitters, [found.get(i, (0, 0)) for i in range(len(splitters) + 1)]


def level_for(loads: list[int], volume: int) -> list[int]:
    """What to add to each load so that all reach one level, ``volume`` in sum."""
    order, held = sorted(range(len(loads)), key=loads.__getitem__), 0
    for n, i in enumerate(order):
        held += loads[i]
        level = (volume + held) / (n + 1)
        if n + 1 == len(order) or level <= loads[order[n + 1]]:
            break
    return [max(0, round(level) - x) for x in loads]


def shard(
    docs: DataFrame,
    shards: int = 24,
    fine: int = 100,
    overhead: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Put every row into a shard so that the shards' sizes in bytes are near equal.

    A row's size is its text's UTF-8 bytes plus ``overhead``. Rows are ordered
    by (hash of the text, hash of the id), so copies of a text lie together;
    sampled splitters cut that order into ranges, exact range sizes give each
    range its place on the line of bytes, and a shard is a stretch of that
    line. Rows of over 1/``fine`` of a mean shard (fewer than ``shards *
    fine`` by arithmetic) are dealt first, largest first to the least loaded
    shard; the stretches then fill all shards to one level. A shard is off
    the mean by one such fraction at most, unless a single row is larger than
    a shard. Slots number a shard's rows from 0.

    Only ids, sizes and hashes are shuffled, once. A hot text is spread over
    ranges by the id's hash. There are eight ranges a shard or one for each
    ``ROWS_A_RANGE`` rows, ``MOST_RANGES`` at most; with more than 65 billion
    rows the ranges grow instead of their number. The driver holds the splitters
    and ``MOST_SAMPLES`` sampled keys, of 32 characters each.

    Defined cases: a null text has no bytes and the CRC of an empty one; null
    ids sort by one hash; repeated rows get slots of their own; an empty table
    gives no rows; other columns are ignored.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        unsigned_crc32(text).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"),
        F.xxhash64(F.col(id_col).cast("long")).alias("id_key"),
    )
    rows = materialise(rows, "shard-rows")
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    unit = max(1, total // (shards * fine))
    large, small = rows.where(F.col("size") > unit), rows.where(F.col("size") <= unit)

    # fewer than shards * fine rows, so one array holds them
    fields = ["size", "text_key", "id_key", "doc_id", "text_crc32"]
    gathered = large.agg(F.sort_array(F.collect_list(F.struct(*fields)), asc=False).alias("rows"))
    zeros = F.array_repeat(F.lit(0).cast("long"), shards)
    start = F.struct(zeros.alias("loads"), zeros.alias("counts"), F.array().cast("array<struct<shard:int,slot:long>>").alias("out"))

    def place(acc: Column, row: Column) -> Column:
        at = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        bump = lambda xs, by: F.transform(xs, lambda x, i: F.when(i == at, x + by).otherwise(x))
        return F.struct(
            bump(acc["loads"], row["size"]).alias("loads"),
            bump(acc["counts"], F.lit(1).cast("long")).alias("counts"),
            F.concat(acc["out"], F.array(F.struct(at.alias("shard"), F.get(acc["counts"], at).alias("slot")))).alias("out"),
        )

    dealt = materialise(gathered.select("rows", F.aggregate("rows", start, place).alias("to")), "shard-large")
    loads, counts = dealt.select("to.loads", "to.counts").first() or ([0] * shards, [0] * shards)
    first_part = dealt.select(F.explode(F.arrays_zip("rows", F.col("to.out").alias("out"))).alias("x")).select(
        "x.rows.doc_id", "x.rows.size", "x.rows.text_crc32", "x.out.shard", "x.out.slot"
    )

    small_total = total - sum(loads)
    small = small.withColumn("key", composite_key())
    # ranges follow the rows, so that a task orders about as many at any size
    ranges = min(max(8 * shards, n_rows // ROWS_A_RANGE), MOST_RANGES)
    splitters, each = find_splitters(small, max(1, small_total), ranges, max(4, min(32, MOST_SAMPLES // ranges)))
    ranged = small.withColumn("range", _range_of(splitters))
    before_bytes = [0, *accumulate(n for n, _ in each)]
    before_rows = [0, *accumulate(n for _, n in each)]
    ends = list(accumulate(level_for(list(loads), small_total)))[:-1]

    order = Window.partitionBy("range").orderBy("text_key", "id_key", "size", "text_crc32", "doc_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the middle of a row on the line of bytes, doubled to stay whole
    placed = ranged.select(
        "doc_id", "size", "text_crc32",
        (F.get(_longs(before_bytes), F.col("range")) * 2 + F.sum("size").over(so_far) * 2 - F.col("size")).alias("middle"),
        (F.get(_longs(before_rows), F.col("range")) + F.row_number().over(order) - 1).alias("place"),
    ).withColumn("shard", F.size(F.filter(_longs(ends), lambda e: e * 2 <= F.col("middle"))) if ends else F.lit(0))
    placed = materialise(placed, "shard-places")
    starts = {r.shard: r.low for r in placed.groupBy("shard").agg(F.min("place").alias("low")).collect()}
    shift = _longs([counts[s] - starts.get(s, 0) for s in range(shards)])
    rest = placed.select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.get(shift, F.col("shard"))).alias("slot"))
    return first_part.unionByName(rest).select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shard_of_range(splitters: list[str], key: str) -> int:
    """The range that a key falls into; the scalar form of the operator's lookup."""
    return bisect_right(splitters, key)
