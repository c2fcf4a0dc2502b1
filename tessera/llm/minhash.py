"""b-bit MinHash near-duplicate classes, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise

HASHES, ROWS, LANES = 128, 5, 0x5555555555555555
BANDS = HASHES // ROWS
BROADCAST_ROWS = 1_000_000
FIRST_BANDS = 8
SMALL_BUCKET = 256
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept in a bounded table."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` lower-cased words.

    Fewer words than ``width`` make one shingle; no words, no text: none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total = mixed(total ^ h[i : len(h) - n + 1 + i]) + np.uint64(i)
    return np.unique(total)


_rng = np.random.default_rng(20240229)
_SEEDS = _rng.integers(0, 1 << 32, HASHES, np.uint32)[:, None]
_ODD = (_rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1))[:, None]


def minima(shingles: np.ndarray, block: int = 4096) -> np.ndarray:
    """The least value of each of the 128 permutations of the sets' 32-bit hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), block):
        y = (x[None, i : i + block] ^ _SEEDS) * _ODD
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(low, y.min(axis=1), out=low)
    return low


_SHIFTS = (2 * np.arange(32)).astype(np.uint64)


def packed(low: np.ndarray) -> np.ndarray:
    """Two low bits of each minimum, 32 to a 64-bit word."""
    bits = (low & np.uint32(3)).astype(np.uint64).reshape(4, 32) << _SHIFTS
    return np.bitwise_or.reduce(bits, axis=1).view(np.int64)


def bands(low: np.ndarray) -> np.ndarray:
    rows = low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * _M1
    for i in range(ROWS):
        total = mixed(total ^ rows[:, i])
    return total.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n_shingles, set_key, sig, bands); the last three are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            n, keys, sigs, bs = [], [], [], []
            for value in b.column(1):
                s = shingle_set(value.as_py(), hashes, width)
                n.append(len(s))
                if len(s):
                    low = minima(s)
                    keys.append(set_digest(s))
                    sigs.append(packed(low))
                    bs.append(bands(low))
                else:
                    keys.append(None)
                    sigs.append(None)
                    bs.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, longs), pa.array(bs, longs)],
                ["id", "n_shingles", "set_key", "sig", "bands"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(
        run, "id long, n_shingles long, set_key binary, sig array<long>, bands array<long>"
    )


def set_digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, set_key, shingles) of (id, text): sorted distinct shingle hashes as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(v.as_py(), hashes, width) for v in b.column(1)]
            keys = pa.array([set_digest(s) for s in sets], pa.binary())
            longs = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), keys, longs], ["id", "set_key", "shingles"])

    return docs.select("id", F.col("text").cast("binary")).mapInArrow(run, "id long, set_key binary, shingles array<long>")


def mismatches(a: str, b: str) -> Column:
    """Lanes of two bits that differ between two packed signatures."""
    total = F.lit(0)
    for i in range(4):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LANES)))
    return total


def estimate(a: str, b: str) -> Column:
    """Similarity with the chance agreement of two-bit values (a quarter) taken out."""
    return (1 - mismatches(a, b) / HASHES - 0.25) / 0.75


def could_link(percent: int, a: str, b: str) -> Column:
    """Size ratio, and an estimate less than six standard deviations under the threshold."""
    p = 0.25 + 0.75 * percent / 100
    most = int(HASHES * (1 - p) + 6 * (HASHES * p * (1 - p)) ** 0.5)
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (mismatches(f"{a}.sig", f"{b}.sig") <= most)


def sent(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast if it is small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst) of (id, part, shingles): all pairs of different parts that can meet the threshold, and a few more.

    An exact set join: shingles are ordered by the number of sets that hold
    them, ties by value; two sets of similarity t share one among the first
    n - ceil(t n) + 1 of each, and where the first common one stands at places
    i and j, 1 + min(n - i - 1, m - j - 1) is at least t (n + m) / (1 + t).
    Shingles of one set alone are counted, not shuffled on; so a set whose
    prefix holds no others meets nothing, however many near copies it has.
    """
    each = sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = materialise(each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    met = each.join(often, "s").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("common"))
    alone = F.col("n") - F.size("common")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - alone
    met = met.where(length > 0).select("id", "n", alone.alias("alone"), F.posexplode(F.slice("common", 1, F.greatest(length, F.lit(0)))).alias("i", "x"))
    met = met.join(sent(materialise(sets.select("id", "part"), "set-parts")), "id")
    met = materialise(met.select("id", "n", "part", (F.col("alone") + F.col("i")).alias("i"), F.col("x.s").alias("s")), "prefixes")
    least = F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i"))
    return (
        met.alias("a")
        .join(
            met.alias("b"),
            (F.col("a.s") == F.col("b.s"))
            & (F.col("a.id") < F.col("b.id"))
            & (F.col("a.part") != F.col("b.part"))
            & (least * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent),
        )
        .select(F.col("b.id").alias("src"), F.col("a.id").alias("dst"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    width: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``.

    Two documents are linked when 100 * |A and B| >= ``percent`` * |A or B| for
    their sets of ``width``-word shingles. Steps: documents with equal sets
    become one class; 128 minima give 25 band keys of five and two bits each;
    each class meets the smallest id of its first eight buckets; then, in all
    buckets that hold several components, the bucket's own smallest id; then,
    of buckets that are split even so, the members that the packed estimates
    do not rule out meet in an exact set join on their rarest shingles (never
    within one component). Pairs that pass the packed estimate are confirmed on
    the full sets. A pair at 0.85 misses all 25 bands with probability 4e-7,
    and one above it less.

    Full sets are made again from the texts of the documents in question, so a
    set is shuffled only to the hub that it is compared with.

    Defined cases: null, empty and blank texts have no shingles, link with
    nothing and are kept; rows with one id are one document, all of them kept
    or none, and where their sets differ it is the one of the smallest digest
    that is compared; a null id is kept with a null component; an empty table
    gives no rows; other columns of ``docs`` are ignored.
    """
    rows = materialise(signatures(docs, id_col, text_col, width), "signatures")
    named = rows.where("set_key is not null and id is not null")
    repeated = named.groupBy("id").agg(F.count("*").alias("n"), F.min("set_key").alias("chosen")).where("n > 1")
    repeated = materialise(repeated.select("id", "chosen"), "repeated-ids")
    unique = repeated.isEmpty()
    if not unique:
        named = named.join(sent(repeated), "id", "left").where(F.coalesce("chosen", "set_key") == F.col("set_key"))
    classes = materialise(
        named.groupBy("set_key")
        .agg(
            F.min("id").alias("cid"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sig").alias("sig"),
            F.first("bands").alias("bands"),
        ),
        "classes",
    )
    sketch = classes.select("cid", "n_shingles", "sig")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(id, shingles) of the ids in ``wanted``."""
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        found = shingle_sets(texts.join(sent(wanted), "id", "left_semi"), width)
        if not unique:
            found = found.join(sent(repeated), "id", "left").where(F.coalesce("chosen", "set_key") == F.col("set_key"))
            found = found.dropDuplicates(["id"])
        return found.select("id", "shingles")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """The (src, dst) of ``pairs`` whose estimate, then full sets, meet the threshold."""
        pairs = (
            pairs.join(sketch.withColumnRenamed("cid", "src").alias("a"), "src")
            .join(sketch.withColumnRenamed("cid", "dst").alias("b"), "dst")
            .where(could_link(percent, "a", "b"))
            .select("src", "dst")
        )
        pairs = materialise(pairs, name)
        members = materialise(pairs.select(F.col("src").alias("id")).distinct(), f"{name}-members")
        hubs = materialise(pairs.select(F.col("dst").alias("id")).distinct(), f"{name}-hubs")
        left = sets_of(members).join(sent(pairs).withColumnRenamed("src", "id"), "id")
        left = left.select(F.col("id").alias("src"), "dst", F.col("shingles").alias("sa"))
        right = sets_of(hubs).select(F.col("id").alias("dst"), F.col("shingles").alias("sb"))
        return materialise(
            left.join(right, "dst")
            .withColumn("both", F.size(F.array_intersect("sa", "sb")))
            .where(F.col("both") * 100 >= (F.size("sa") + F.size("sb") - F.col("both")) * percent)
            .select("src", "dst"),
            f"{name}-links",
        )

    def merged(parts: DataFrame | None, links: DataFrame) -> DataFrame:
        if parts is not None:
            links = links.union(parts.select(F.col("node").alias("src"), F.col("component").alias("dst")))
        return materialise(connected_components(links), "parts")

    # each class with the smallest hub of its first buckets: one pair a class joins most groups
    slots = classes.select("cid", F.explode(F.slice("bands", 1, FIRST_BANDS)).alias("bucket"))
    shared = slots.groupBy("bucket").agg(F.min("cid").alias("hub"), F.count("*").alias("n")).where("n > 1")
    shared = sent(materialise(shared.select("bucket", "hub"), "shared-buckets"))
    hubs = slots.join(shared, "bucket").where("cid <> hub")
    hubs = hubs.groupBy(F.col("cid").alias("src")).agg(F.min("hub").alias("dst"))
    parts = merged(None, confirmed(hubs, "first-hubs"))

    # the hubs of all buckets that hold more than one component yet
    labelled = classes.join(parts, F.col("cid") == F.col("node"), "left")
    labelled = labelled.select("cid", F.coalesce("component", "cid").alias("part"), F.explode("bands").alias("bucket"))
    split = labelled.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("cid").alias("hub"))
    split = sent(materialise(split.where("low < high").select("bucket", "hub"), "split-buckets"))
    open_ = materialise(labelled.join(split, "bucket"), "open-buckets")
    hub_part = open_.where("cid = hub").select("bucket", F.col("part").alias("hub_part"))
    other = open_.where("cid <> hub").join(hub_part, "bucket").where("part <> hub_part")
    other = other.select(F.col("cid").alias("src"), F.col("hub").alias("dst")).distinct()
    parts = merged(parts, confirmed(other, "other-hubs"))

    # what is split even then; in small buckets, only who has a partner in another component by the estimate
    left = open_.drop("part").join(parts, F.col("cid") == F.col("node"), "left")
    left = left.select("cid", "bucket", F.coalesce("component", "cid").alias("part"))
    split = left.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"))
    left = left.join(split.where("low < high").select("bucket", "n"), "bucket")
    left = materialise(left.join(sketch, "cid"), "open-members")
    few = left.where(F.col("n") <= SMALL_BUCKET)
    partner = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.part") != F.col("b.part")) & could_link(percent, "a", "b")
    some = few.alias("a").join(few.alias("b"), partner, "left_semi")
    some = some.union(left.where(F.col("n") > SMALL_BUCKET)).select(F.col("cid").alias("id"), "part").distinct()
    some = materialise(some, "rest-members")
    if not some.isEmpty():
        sets = materialise(sets_of(some.select("id")).join(sent(some), "id"), "rest-sets")
        parts = merged(parts, confirmed(prefix_pairs(sets, percent), "rest-pairs"))

    labels = classes.select("set_key", "cid").join(parts, F.col("cid") == F.col("node"), "left")
    labels = labels.select(F.col("set_key").alias("chosen_key"), F.coalesce("component", "cid").alias("component"))
    chosen = rows.withColumn("chosen_key", F.col("set_key"))
    if not unique:
        chosen = rows.join(sent(repeated), "id", "left").withColumn("chosen_key", F.when(F.col("set_key").isNotNull(), F.coalesce("chosen", "set_key")))
    return chosen.join(labels, "chosen_key", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.coalesce(F.col("component").isNull() | (F.col("id") == F.col("component")), F.lit(True)).alias("kept"),
    )
