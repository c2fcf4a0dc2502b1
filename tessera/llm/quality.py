"""Quality rules: base text statistics and an n-gram likelihood ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BROADCAST_LABELS = 4_000_000
BROADCAST_ROWS = 2_000_000
BROADCAST_BITS = 25  # nine bytes a bucket
BLANK = "[ \\t-\\r]+"
SYMBOLS = "[^#*$%&|<>]+"


def with_words(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """(id, text, n, hashes): the text, its white-space words and a 64-bit hash of each.

    With ``carry``, ``row`` holds all columns of ``docs`` besides.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    found = docs.select(F.col(id_col).alias("id"), text.alias("text"), *row)
    found = found.withColumn("trimmed", F.btrim("text", F.lit(" \t\n\x0b\f\r")))
    words = F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", BLANK))
    found = found.withColumn("words", words)
    return found.select("id", "text", *["row"] * carry, F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def _joined(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))


def _from(hashes: Column, start: int, fewer: int) -> Column:
    """All but ``fewer`` of the elements, from place ``start`` (1 is the first)."""
    return F.slice(hashes, start, F.greatest(F.size(hashes) - fewer, F.lit(0)))


def with_pairs(words: DataFrame) -> DataFrame:
    """Adds pairs: a hash of each two adjacent words."""
    h = F.col("hashes")
    return words.withColumn("pairs", _joined(_from(h, 1, 1), _from(h, 2, 1)))


def with_repeats(words: DataFrame) -> DataFrame:
    """Adds n_repeat: words inside five-word windows that occur twice or more in the text.

    A window's hash is built from those of its pairs. Distinct window hashes
    are counted first; only texts with a repeat sort (hash, place) pairs, so a
    text of n words takes n log n steps.
    """
    pairs, hashes = F.col("pairs"), F.col("hashes")
    found = words.withColumn("fours", _joined(_from(pairs, 1, 2), _from(pairs, 3, 2)))
    fours = F.col("fours")
    found = found.withColumn("windows", _joined(_from(fours, 1, 1), _from(hashes, 5, 4))).drop("fours")
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    # the places of windows whose hash stands beside an equal one in sorted order
    placed = F.when(
        repeated, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    found = found.withColumn("placed", placed).drop("windows")
    p = F.col("placed")
    twice = F.filter(
        p,
        lambda x, i: ((i > 0) & (F.get(p, i - 1)["h"] == x["h"])) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False)),
    )
    found = found.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("placed")
    s = F.col("starts")
    covered = F.aggregate(
        F.transform(s, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(s, i + 1) - x, F.lit(5)))),
        F.lit(0),
        lambda a, b: a + b,
    )
    return found.withColumn("n_repeat", F.coalesce(covered, F.lit(0))).drop("starts")


def table_bits(n_bytes: int) -> int:
    """The hashed table has 2**bits buckets: 400 times the cube root of the corpus' bytes, rounded up.

    25 MB of text get 2**17 buckets, 50 GB 2**21 and 170 TB 2**25, so it grows with the
    corpus, and a task's part of the counts stays under its part of the input.
    """
    return max(10, int(400 * n_bytes ** (1 / 3)).bit_length())


def bucket(hashed: Column, bits: int) -> Column:
    """The upper bits of a 64-bit hash."""
    return F.shiftrightunsigned(hashed, 64 - bits).cast("int")


def each_gram(words: DataFrame, bits: int) -> DataFrame:
    """(k, l, good, b): the bucket of each word and word pair of each row."""
    # an inner explode would infer a filter that repeats the whole expression under it
    grams = words.select("k", "l", F.coalesce("good", F.lit(0)).alias("good"), F.explode_outer(F.concat("hashes", "pairs")).alias("g"))
    return grams.where("g is not null").select("k", "l", "good", bucket(F.col("g"), bits).alias("b"))


def gram_table(grams: DataFrame) -> DataFrame:
    """(block, w): the weights of 64 buckets; that of bucket b and a row with mark ``good`` is at 2 (b % 64) + good.

    The raw multinomial counts the words and word pairs of every row, the
    target one those of every row labelled good; counts are combined before
    the shuffle. A weight is ln(p_target / p_raw) in whole thousandths, the
    target's share smoothed by one count at the raw share. A gram is judged by
    the others: its own count is taken out of both, so a row labelled good does
    not speak for itself.
    """
    counts = grams.groupBy("b").agg(F.count("*").alias("r"), F.sum(F.col("good").cast("long")).alias("t"))
    counts = materialise(counts, "gram-counts")
    size = counts.agg(F.sum("r").alias("raw"), F.sum("t").alias("target")).first()
    share = (size.target or 0) / (size.raw or 1)

    def weight(good: int) -> Column:
        ratio = (F.greatest(F.col("t") - good, F.lit(0)) + 1) / ((F.col("r") - 1) * F.lit(share) + 1)
        return F.round(F.log(ratio) * 1000).cast("int") if share else F.lit(0)

    both = F.struct(weight(0).alias("other"), weight(1).alias("good"))
    entry = F.struct(F.col("b").bitwiseAND(63).alias("at"), both.alias("w"))
    blocks = counts.groupBy(F.shiftright("b", 6).alias("block")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    place = lambda i: F.element_at("m", F.shiftright(i, 1))
    found = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.coalesce(F.when(i % 2 == 0, place(i)["other"]).otherwise(place(i)["good"]), F.lit(0)))
    return materialise(blocks.select("block", found.alias("w")), "gram-weights")


def gram_means(grams: DataFrame, bits: int) -> DataFrame:
    """(k, l, llr_millis): the mean weight of each row's grams, rounded towards minus infinity.

    The table is sent while it has ``BROADCAST_BITS`` bits at most, so that
    only one row a document is shuffled; beyond, grams meet it in a shuffle join.
    Rows of one key have equal grams, and their mean is that of one.
    """
    table = gram_table(grams)
    if bits <= BROADCAST_BITS:
        table = F.broadcast(table)
    found = grams.withColumn("block", F.shiftright("b", 6)).join(table, "block")
    weight = F.get("w", F.col("b").bitwiseAND(63) * 2 + F.col("good"))
    found = found.groupBy("k", "l").agg(F.sum(weight.cast("long")).alias("total"), F.count("*").alias("n"))
    return found.select("k", "l", F.floor(F.col("total") / F.col("n")).alias("llr_millis"))


def score_threshold(scores: list[tuple[int, int, int]], good_share: float = 0.99) -> int:
    """The cut, in thousandths, of (score, good, rows) of labelled rows.

    It parts good rows from the others best (largest difference of the shares
    kept, the lowest such score) and lies half way down to the next labelled
    score, so that rows without a label which are a little worse than the
    worst good one stay. Without other rows it keeps ``good_share`` of the good
    ones.
    """
    all_good, all_other = (sum(n for _, g, n in scores if g == kind) for kind in (1, 0))
    if not all_good:
        return min((s for s, _, _ in scores), default=0)
    by_score: dict[int, list[int]] = {}
    for score, good, n in scores:
        by_score.setdefault(score, [0, 0])[good] += n
    best, cut, good, other = None, 0, all_good, all_other
    for score in sorted(by_score):
        if all_other:
            gain = good / all_good - other / all_other
        else:
            gain = score if good >= good_share * all_good else None
        if gain is not None and (best is None or gain > best):
            best, cut = gain, score
        other, good = other - by_score[score][0], good - by_score[score][1]
    below = max((s for s in by_score if s < cut), default=None)
    return cut if below is None or not all_other else (cut + below + 1) // 2


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    threshold: float | None = None,
    min_words: int = 10,
    max_repeat: float = 0.2,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
) -> DataFrame:
    """One row a document: base statistics, likelihood ratio a gram, verdicts.

    Columns: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (under ``min_words`` words, or more than ``max_repeat`` of the
    words in repeated windows), llr_millis (mean over a text's words and word
    pairs of the ratio's logarithm, in thousandths, rounded towards minus
    infinity), kept (base holds and the mean is at least ``threshold``, by
    default the score that parts the labelled rows best). Whole numbers keep
    it equal on every run. With ``carry`` the columns of ``docs`` stand in
    place of the statistics, beside ``__kept``.

    Texts are read three times, to count grams, to weigh them and to judge, and
    are not shuffled while the labels, the table and the means are small enough
    to be sent (their sizes are checked); beyond that they meet in shuffle joins.

    Defined cases: null, empty and blank texts have no words and fail; a table
    without good labels scores every document 0; repeated rows are judged one by
    one; null ids pass through; other columns are ignored.
    """
    marks = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("k"))
        .agg(F.max((F.col(label_col) == 1).cast("int")).alias("good"))
    )
    marks = materialise(marks, "labels")
    if marks.count() <= BROADCAST_LABELS:  # twelve bytes each
        marks = F.broadcast(marks)
    columns = docs.columns if carry else list(dict.fromkeys([id_col, text_col]))
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    rows = rows.join(marks, "k", "left").select("k", "row", "good", F.col("row")[text_col].alias("t"))
    words = with_pairs(with_words(rows, "k", "t", carry=True))
    # 96 bits of hashes stand for an id and its text
    key = [F.xxhash64("id", "text").alias("k"), F.hash("text", "id").alias("l")]
    words = words.select(*key, "row.good", "row.row", "text", "n", "hashes", "pairs")
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    bits = table_bits(n_bytes)
    means = materialise(gram_means(each_gram(words, bits), bits), "gram-means")

    found = with_repeats(words)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    found = found.withColumn("lines", lines)
    judged = found.select(
        "k", "l", "good",
        *(["row"] if carry else [F.col("row")[id_col].alias(id_col)]),
        F.col("n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", BLANK, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat").cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * round(100 * max_repeat))
    judged = judged.withColumn("base_failed", failed)
    if means.count() <= BROADCAST_ROWS:  # twenty bytes each
        means = F.broadcast(means)
    judged = judged.join(means, ["k", "l"], "left").withColumn("llr_millis", F.coalesce("llr_millis", F.lit(0)))
    judged = materialise(judged.drop("k", "l"), "judged")
    if threshold is not None:
        cut = round(1000 * threshold)
    else:
        # whole thousandths: few groups
        marked = judged.where(~F.col("base_failed") & F.col("good").isNotNull()).groupBy("llr_millis", "good").count().collect()
        cut = score_threshold([(r[0], r[1], r[2]) for r in marked])
    kept = ~F.col("base_failed") & (F.col("llr_millis") >= cut)
    if carry:
        return judged.select("row.*", kept.alias("__kept"))
    return judged.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr_millis", "base_failed", kept.alias("kept")
    )
