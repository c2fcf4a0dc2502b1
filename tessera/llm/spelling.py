"""Grouping of spelling variants by letter-parity masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

WORD = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BANDS = 3
BITS = 57  # 19 a band; a letter's bit is its code point modulo this, its band the bit modulo 3


def word_counts(docs: DataFrame, damage: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): every word of every text, and how often it occurs.

    A run of letters, lower-cased in A to Z, loses a code point where ``damage``
    divides the CRC-32 of ``<id>:<run>``: the one at that number modulo the run's
    length. A null id counts as empty, a null text has no words.
    """
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(WORD), F.lit(0))
    words = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    cut = F.concat(F.expr("run").substr(F.lit(1), at), F.expr("run").substr(at + 2, F.length("run")))
    return words.select(F.when(h % damage == 0, cut).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def parity_mask(word: Column) -> Column:
    """A bit for each letter: whether the word has it an odd number of times."""
    one = F.lit(1).cast("long")
    bits = F.transform(F.split(word, ""), lambda c: F.call_function("shiftleft", one, F.pmod(F.ascii(c), F.lit(BITS))))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda mask, bit: mask.bitwiseXOR(bit))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): every two words of ``words(word, n)`` that differ by one inserted, deleted or replaced code point, once.

    One edit flips at most two bits of the masks, so of three bands one at
    least is equal; it leaves the first or the last half of the shorter word in
    place, so these halves are equal too. Words meet where a band, the length of
    the shorter word and a half agree: a word comes as one of length m, and as
    one that is longer by one than m. Bands that many words share are so split
    by the halves. A pair that meets in several keys is verified in the first.

    A word is six rows of keys, which Spark's estimate of an explode leaves out,
    so it may take them for small and broadcast them: the joins here are told to sort.
    """
    length = F.length("word")
    marked = words.select("word", "n", length.alias("size"), parity_mask(F.col("word")).alias("mask"))
    bands = F.array(*(F.col("mask").bitwiseAND(F.lit(sum(1 << i for i in range(k, BITS, BANDS)))) for k in range(BANDS)))
    marked = marked.withColumn("bands", bands)

    def keyed(rows: DataFrame, shorter: Column) -> DataFrame:
        half = F.floor(shorter / 2).cast("int")
        halves = F.array(F.substring("word", F.lit(1), half), F.expr("word").substr(F.col("size") - (shorter - half) + 1, shorter - half))
        rows = rows.select("*", shorter.alias("m"), halves.alias("halves"))
        rows = rows.select("*", F.posexplode("bands").alias("band", "value"))
        return rows.select("*", F.posexplode("halves").alias("side", "half"))

    # neither an earlier band nor, with the same band, an earlier half is equal
    first = ~((F.col("a.side") == 1) & (F.col("a.halves")[0] == F.col("b.halves")[0]))
    for k in range(BANDS - 1):
        first &= ~((F.col("a.band") > k) & (F.col("a.bands")[k] == F.col("b.bands")[k]))
    on = first & (F.levenshtein("a.word", "b.word", 1) == 1)
    for k in ("m", "band", "value", "side", "half"):
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")

    def met(right: DataFrame, order: Column) -> DataFrame:
        pairs = keyed(marked, F.col("size")).alias("a").join(right.hint("merge").alias("b"), on & order)
        return pairs.select(F.col("a.word").alias("a"), F.col("a.n").alias("na"), F.col("b.word").alias("b"), F.col("b.n").alias("nb"))

    same = met(keyed(marked, F.col("size")), F.col("a.word") < F.col("b.word"))
    return same.unionByName(met(keyed(marked, F.col("size") - 1), F.lit(True)))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of ``forms(word, form)``.

    Every round doubles the steps taken. A form is at least ``ratio`` times as
    frequent as its word, so no chain is a circle, and a few rounds end all.
    """
    forms = materialise(forms, "forms")
    paths = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        paths = materialise(paths.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not paths.where("moved").limit(1).count():
            return paths.select("word", "root")
        paths = paths.select("word", "root")


def spelling_groups(
    docs: DataFrame,
    least_length: int = 6,
    least_count: int = 5,
    ratio: int = 5,
    damage: int = 199,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word, its likelier spelling, and the group's root.

    Words are those of ``word_counts`` with at least ``least_length`` code
    points and ``least_count`` occurrences. A word's form is its most frequent
    near word (ties: the smallest in code-point order), if that occurs at least
    ``ratio`` times as often; its root the end of the chain of forms.

    Defined cases: null and empty texts have no words; texts of any length are
    read whole; repeated rows count again; a word without a near one has n_near 0,
    no form and itself as root; an empty table gives no rows; other columns are ignored.
    """
    counts = word_counts(docs, damage, id_col, text_col)
    words = materialise(counts.where((F.length("word") >= least_length) & (F.col("n") >= least_count)), "words")
    pairs = materialise(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n"))
    both = both.union(pairs.select("b", "a", "na"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    found = words.join(best.hint("merge"), "word", "left")
    large = -F.col("best.m") >= ratio * F.col("n")
    found = materialise(
        found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.m")).alias("form_n")),
        "spellings",
    )
    roots = roots_of(found.where("form is not null").select("word", "form"))
    return found.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
