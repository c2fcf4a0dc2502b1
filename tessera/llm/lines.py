"""Near-duplicate lines by a segment-partition edit join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BROADCAST_KEYS = 1_000_000
HOT_KEY = 64


def normal_lines(text: Column) -> Column:
    """The \\n-split lines, lower-cased and with blanks collapsed; ``trim`` takes those at their ends."""
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    # most texts hold single blanks only, and searches are cheaper than a replacement of each blank by itself
    odd = low.contains("  ")
    for blank in "\t\x0b\f\r":
        odd = odd | low.contains(blank)
    flat = F.when(odd, F.regexp_replace(low, "[ \\t\\x0B\\f\\r]+", " ")).otherwise(low)
    return F.split(flat, "\n")


def segment_places(n: Column, tau: int) -> tuple[list[tuple], list[tuple]]:
    """(start, size, number, indexed length) of the segments that index a line of ``n`` characters, and of those that it probes besides.

    A line of length l is cut into tau + 1 segments, the first ones shorter
    by at most one. If two lines are within ``tau`` edits, a segment of the
    shorter one stands in the longer one, at a start within the
    multi-match-aware bounds: for segment i (from 0) at p and a length
    difference d, from p + max(-i, d - (tau - i)) to p + min(i, d + tau - i).
    Probes of a line's own length that equal its index are not repeated.
    """
    index, probes = [], []
    for d in range(tau + 1):
        length = n - d
        short = F.call_function("div", length, F.lit(tau + 1)).cast("int")
        longer = length - short * (tau + 1)  # the last so many segments have one more
        for i in range(tau + 1):
            first_long = (tau + 1) - longer
            start = short * i + F.greatest(F.lit(i) - first_long, F.lit(0))
            size = short + (F.lit(i) >= first_long).cast("int")
            for shift in range(max(-i, d - (tau - i)), min(i, d + tau - i) + 1):
                (index if d == 0 and shift == 0 else probes).append((start + shift, size, i, length))
    return index, probes


def segment_keys(wide: Column, n: Column, tau: int) -> Column:
    """Hashes that index a line of ``n`` characters, ``tau`` + 1 of them, and behind them those that it probes besides.

    Keys hold a segment's text, its number and the indexed length. ``wide``
    holds four bytes a character, so that a segment is found by its place
    without a search; it and ``n`` are columns, not expressions, which each
    key would evaluate again.
    """
    index, probes = segment_places(n, tau)
    return F.array(*(F.xxhash64(F.substring(wide, start * 4 + 1, size * 4), F.lit(i), length) for start, size, i, length in index + probes))


def wide(line: Column) -> Column:
    return F.encode(line, "UTF-32")


def code_points(line: Column, tau: int) -> Column:
    """The characters of a line as numbers, with tau + 1 equal ones at the end."""
    return F.concat(F.transform(F.split(line, ""), lambda c: F.ascii(c)), F.array_repeat(F.lit(-1), tau + 1))


def distance_within(a: Column, b: Column, tau: int) -> Column:
    """Whether two lines are within ``tau`` edits, by a banded bit-parallel recurrence.

    Bit i of the words stands for row j - tau + i of column j, so the whole
    band of 2 tau + 1 rows moves through one machine word (vertical deltas
    VP and VN, diagonal ones D0); ``d`` follows the lower edge of the band
    and then the last row. Both are columns of ``code_points``, not
    expressions, which a lambda would evaluate again at each step; their
    equal ends add no edits. Two half steps share a state, because a SQL
    lambda cannot name D0.
    """
    xs, ys = a, b
    m, n = F.size(a), F.size(b)
    top, mask = 1 << (2 * tau), (1 << (2 * tau + 1)) - 1
    state = "struct<vp:bigint,vn:bigint,d0:bigint,d:int>"
    start = F.struct(
        F.lit(((1 << (tau + 1)) - 1) << tau).cast("bigint").alias("vp"),
        F.lit(0).cast("bigint").alias("vn"),
        F.lit(0).cast("bigint").alias("d0"),
        F.lit(tau).alias("d"),
    ).cast(state)

    def step(s: Column, t: Column) -> Column:
        j = F.shiftright(t, 1)
        y = F.get(ys, j - 1)
        same = F.lit(0).cast("bigint")
        for i in range(2 * tau + 1):
            hit = F.get(xs, j - 1 - tau + i) == y
            same = same.bitwiseOR(F.when(hit, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        vp, vn, d0 = s["vp"], s["vn"], s["d0"]
        carry = (same.bitwiseAND(vp) + vp).bitwiseXOR(vp)
        first = F.struct(
            vp.alias("vp"), vn.alias("vn"), carry.bitwiseOR(same).bitwiseOR(vn).bitwiseAND(F.lit(mask)).alias("d0"), s["d"].alias("d")
        )
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(F.lit(mask)))
        hn = d0.bitwiseAND(vp)
        half = F.shiftrightunsigned(d0, 1)
        row = F.call_function("shiftleft", F.lit(1).cast("bigint"), m - j + tau)
        on = lambda x, bit: F.when(x.bitwiseAND(bit) != 0, 1).otherwise(0)
        moved = F.when(j <= m - tau, 1 - on(d0, F.lit(top))).otherwise(on(hp, row) - on(hn, row))
        second = F.struct(
            hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp)).bitwiseAND(F.lit(mask))).alias("vp"),
            hp.bitwiseAND(half).alias("vn"),
            d0.alias("d0"),
            (s["d"] + moved).alias("d"),
        )
        return F.when(t % 2 == 0, first).otherwise(second).cast(state)

    last = F.aggregate(F.sequence(F.lit(2), 2 * n + 1), start, step)
    return last["d"] <= tau


KINDS = ("e", "t", "a", "o", "i", "n", "s", "r", "h", "dl", "cumf", " ")


def sketch(line: Column) -> Column:
    """Counts of twelve kinds of characters; an edit changes their sum of differences by two at most."""
    return F.array(*(F.length(line) - F.length(F.translate(line, kind, "")) for kind in KINDS))


def with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds __k and __l: 128 bits of hashes that stand for an id and its text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    number = F.col(id_col).cast("long")
    return docs.withColumns({"__k": F.xxhash64(number, text), "__l": F.xxhash64(text, number)})


def text_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, l, id, place, line, n): each line, with the number of its characters."""
    rows = with_key(docs, id_col, text_col).select(
        F.col("__k").alias("k"), F.col("__l").alias("l"), F.col(id_col).cast("long").alias("id"),
        # an inner explode would infer a filter that repeats its expression
        F.posexplode_outer(normal_lines(F.col(text_col))).alias("place", "line"),
    )
    return rows.withColumn("line", F.trim("line")).withColumn("n", F.length("line"))


def sent(table: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """A written table, marked for broadcast if it is small enough."""
    return F.broadcast(table) if table.count() <= most else table


def near_lines(lines: DataFrame, docs: DataFrame, tau: int, min_chars: int) -> DataFrame:
    """(h, g): lines that are within ``tau`` edits of an earlier line.

    ``lines`` holds the keys of all lines of ``docs`` (id, text), of which only
    those are read again in which a line with a shared key stands first. Lines
    under ``min_chars`` characters, not ``long``, meet none.
    """
    keyed = lines.where("id is not null and long")
    shared = (
        keyed.select("h", F.posexplode("keys").alias("pos", "key"))
        .groupBy("key")
        .agg(F.min("h").alias("low"), F.max("h").alias("high"), F.min("pos").alias("pos"))
        .where((F.col("low") < F.col("high")) & (F.col("pos") <= tau))
        .select("key")
    )
    shared = sent(materialise(shared, "shared-keys"))
    slots = keyed.select("h", "g", "id", "place", F.posexplode("keys").alias("pos", "key")).join(shared, "key", "left_semi")
    slots = slots.groupBy("h", "g", "key").agg(F.min(F.struct("id", "place")).alias("at"), F.min("pos").alias("pos"))
    slots = slots.select("h", "g", "key", F.col("at.id").alias("first"), "at.place", (F.col("pos") <= tau).alias("indexed"))
    slots = materialise(slots, "slots")

    wanted = materialise(slots.select("h", "g", "first").distinct(), "wanted-lines")
    home = sent(materialise(wanted.select(F.col("first").alias("id")).distinct(), "wanted-documents"))
    found = text_lines(docs.join(home, "id", "left_semi"), "id", "text").where(F.col("n") >= min_chars).select("id", "line")
    found = found.withColumns({"h": F.xxhash64("line"), "g": F.hash("line")})
    found = found.join(sent(wanted).withColumnRenamed("first", "id"), ["id", "h", "g"], "left_semi")
    found = found.dropDuplicates(["h", "g"])
    found = found.select("h", "g", code_points(F.col("line"), tau).alias("points"), sketch(F.col("line")).alias("sketch"))
    found = materialise(found, "slot-texts")
    hot = materialise(slots.groupBy("key").count().where(F.col("count") > HOT_KEY).select("key"), "hot-keys")
    cold = slots if hot.isEmpty() else slots.join(sent(hot), "key", "left_anti")
    later = near_pairs(cold.join(found, ["h", "g"]), ["key"], tau)
    if not hot.isEmpty():
        later = later.union(near_pairs(split_slots(keyed, sent(hot), found, tau), ["key", "second"], tau))
    return later.distinct()


def near_pairs(slots: DataFrame, by: list[str], tau: int) -> DataFrame:
    """(h, g) of the slots' lines that are within ``tau`` edits of an earlier line with an equal key."""
    slots = materialise(slots, "slots-with-texts")
    a, b = slots.alias("a"), slots.alias("b")
    equal = (F.col("a.indexed") | F.col("b.indexed")) & (F.struct("b.first", "b.place", "b.h") < F.struct("a.first", "a.place", "a.h"))
    for k in by:
        equal = equal & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    if len(by) > 1:
        equal = equal & (F.col("a.second_indexed") | F.col("b.second_indexed"))
    difference = sum((F.abs(F.col("a.sketch")[i] - F.col("b.sketch")[i]) for i in range(len(KINDS))), F.lit(0))
    near = (
        equal
        & (F.abs(F.size("a.points") - F.size("b.points")) <= tau)
        & (difference <= 2 * tau)
        & distance_within(F.col("a.points"), F.col("b.points"), tau)
    )
    # a semi join ends its search at the first earlier line, so groups of near copies stay linear
    return a.join(b, near, "left_semi").select("h", "g")


def split_slots(keyed: DataFrame, hot: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    """Slots of keys that very many lines share, with second keys on what is left of each line.

    If two lines are within ``tau`` edits and share a segment that no edit
    touches, their remainders without it are within ``tau`` edits too, so they
    share a segment of the remainders; lines that have one text in common and
    nothing else do not meet.
    """
    rows = keyed.select("h", "g", "id", "place", F.posexplode("keys").alias("pos", "key")).join(hot, "key", "left_semi")
    rows = rows.groupBy("h", "g", "key", "pos").agg(F.min(F.struct("id", "place")).alias("at"))
    rows = rows.join(texts, ["h", "g"]).withColumn("n", F.size("points") - (tau + 1))
    index, probes = segment_places(F.col("n"), tau)
    at = F.array(*(F.struct(start.alias("start"), size.alias("size")) for start, size, _, _ in index + probes))
    rows = rows.withColumn("cut", F.get(at, F.col("pos")))
    start, size = F.col("cut.start"), F.col("cut.size")
    rest = F.concat(F.slice("points", 1, start), F.slice("points", start + size + 1, F.greatest(F.col("n") - start - size, F.lit(0))))
    rows = rows.withColumn("rest", rest).withColumn("m", F.size("rest"))
    index, probes = segment_places(F.col("m"), tau)
    second = F.array(*(F.xxhash64(F.slice("rest", start + 1, size), F.lit(i), length) for start, size, i, length in index + probes))
    rows = rows.select(
        "h", "g", "key", F.col("at.id").alias("first"), F.col("at.place").alias("place"), (F.col("pos") <= tau).alias("indexed"), "points", "sketch",
        F.posexplode(second).alias("at2", "second"),
    )
    return rows.withColumn("second_indexed", F.col("at2") <= tau).drop("at2")


def removed_places(
    docs: DataFrame, tau: int = 2, min_chars: int = 30, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(k, l, removed): numbers, from 0, of the lines to remove from each row that loses any.

    A line goes if an earlier line of its document or any line of an earlier
    document is equal, or, from ``min_chars`` characters on, if an earlier line
    (by first document, then by place in it) is within ``tau`` edits; two edits
    make another word of a shorter one. Of these, lines without a letter or a
    digit stay. Texts are normalised once, into a table of hashes and segment
    keys; all else works on that table.
    """
    long = F.col("n") >= min_chars
    lines = text_lines(docs, id_col, text_col).where(long | F.col("line").rlike(r"[\p{L}\p{N}]"))
    hashes = [F.xxhash64("line").alias("h"), F.hash("line").alias("g")]
    lines = lines.withColumn("wide", wide(F.col("line")))
    keys = segment_keys(F.col("wide"), F.col("n"), tau).alias("keys")
    rows = materialise(lines.select("k", "l", "id", "place", *hashes, long.alias("long"), keys), "lines")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    near = materialise(near_lines(rows, texts, tau, min_chars), "near-lines")
    equal = rows.groupBy("h", "g").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    flagged = equal.select("h", "g", "first").join(near.withColumn("near", F.lit(True)), ["h", "g"], "full_outer")
    flagged = sent(materialise(flagged, "flagged-lines"))
    sure = F.col("id").isNotNull() & (F.coalesce("near", F.lit(False)) | F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    gone = rows.drop("keys", "long").join(flagged, ["h", "g"]).select("k", "l", F.struct("h", "g", "place", sure.alias("sure")).alias("x"))
    gone = gone.groupBy("k", "l").agg(F.sort_array(F.collect_set("x")).alias("xs"))
    xs = F.col("xs")
    again = lambda x, i: (i > 0) & (F.get(xs, i - 1)["h"] == x["h"]) & (F.get(xs, i - 1)["g"] == x["g"])
    places = F.sort_array(F.transform(F.filter(xs, lambda x, i: x["sure"] | again(x, i)), lambda x: x["place"]))
    return materialise(gone.select("k", "l", places.alias("removed")).where(F.size("removed") > 0), "removed-places")


def dedup_lines(
    docs: DataFrame, tau: int = 2, min_chars: int = 30, id_col: str = "doc_id", text_col: str = "text", prefix: str = ""
) -> DataFrame:
    """``docs`` with ``text_col`` less its duplicate lines, plus n_lines, n_removed, removed.

    ``prefix`` goes before the names of these three, for tables that have such columns.

    Within a document the first of equal lines stays; the others of
    ``removed_places`` go. Other lines, their order and spelling are kept;
    ``removed`` lists the numbers, from 0, of the lines that went. They meet the
    texts by a broadcast while there are at most ``BROADCAST_KEYS`` documents and
    four times as many lines, and by a shuffle join beyond.

    Defined cases: null and empty texts stay as they are; lines under
    ``min_chars`` characters go only if an earlier one is equal, and stay if they
    hold no letter or digit, as blank lines and brackets do; rows with a null id lose only their own
    repeats; rows that share an id count as one document; an empty table gives
    no rows; other columns are carried along whatever their names.
    """
    gone = removed_places(docs, tau, min_chars, id_col, text_col)
    if (gone.agg(F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()[0]) <= 4 * BROADCAST_KEYS:
        gone = sent(gone)
    gone = gone.select(F.col("k").alias("__k"), F.col("l").alias("__l"), F.col("removed").alias("__removed"))
    rows = with_key(docs, id_col, text_col).join(gone, ["__k", "__l"], "left")
    rows = rows.withColumn("__removed", F.coalesce("__removed", F.array().cast("array<int>")))
    gaps = F.col("__removed")
    # lines between removed ones, joined again; the cost follows the text's length
    lines = F.split(F.col(text_col).cast("string"), "\n")
    rows = rows.withColumn("__lines", F.when(F.size(gaps) > 0, lines))
    ends = F.concat(gaps, F.array(F.size("__lines")))
    parts = F.transform(
        ends, lambda e, i: F.slice("__lines", F.coalesce(F.get(gaps, i - 1), F.lit(-1)) + 2, e - F.coalesce(F.get(gaps, i - 1), F.lit(-1)) - 1)
    )
    rows = rows.withColumn("__kept", F.when(F.size(gaps) > 0, F.flatten(parts)))
    text = F.coalesce(F.array_join("__kept", "\n"), F.col(text_col))
    whole = F.col(text_col).cast("string")
    n_lines = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    return rows.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(n_lines, F.lit(0)).cast("long").alias(f"{prefix}n_lines"),
        F.size(gaps).cast("long").alias(f"{prefix}n_removed"),
        gaps.alias(f"{prefix}removed"),
    )
