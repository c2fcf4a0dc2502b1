"""Personal data: base patterns, and bootstrapped contextual extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

KINDS = ("email", "ip", "card", "phone")

# Possessive quantifiers and look-behinds only save retries that cannot match;
# \G lets a match begin where the last one ended inside a run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",  # runs of fewer than 13 digits fail as a whole
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# what could name somebody: numbers of seven digits or more, in groups with the separators of the seeds or in one,
# account numbers in groups of four, and words with seven digits or an @
TOKEN = (
    r"(?<![^\s(:;,])(?:"
    r"[(+]{0,2}[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![^\s).,;:!?])"
    r"|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
    r"|(?<!\S)(?=[^\s@]*+@|(?:[^\s0-9]*+[0-9]){7})\S++)"
)
SPAN = "struct<start:int,end:int,value:string>"
PIECES = 256
NEIGHBOURS = 4  # matches that a context reaches over
RIGHT = ">"  # marks cues that stand behind a place


def with_spans(rows: DataFrame, name: str, pattern: str, reach: int) -> DataFrame:
    """``rows`` with ``name``: leftmost non-overlapping matches in ``text`` as (start, end, value, left, right), in code points.

    ``left`` and ``right`` are what stands before and behind a match, ``reach``
    characters at most, and not further than the ``NEIGHBOURS``-th match from it.

    Matches are fenced by two control characters and the text is split at the
    first one; running lengths of the pieces give the places. Those two
    characters in the text itself stand as a third one meanwhile: no pattern
    here matches any of the three. Pieces are added up in runs of ``PIECES``,
    so a text with very many matches costs little more than its matches.
    """
    safe = F.translate("text", "\x01\x02", "\x03\x03")
    fenced = F.split(F.regexp_replace(safe, f"({pattern})", "\x01$1\x02"), "\x01")
    # a column, as a lambda would evaluate the expression again for each match
    rows = rows.withColumn("__parts", F.when(F.col("text").rlike(pattern), fenced))
    parts = F.col("__parts")
    n = F.size(parts) - 1
    none = F.array().cast(f"array<{SPAN}>")

    def take(acc: Column, part: Column) -> Column:
        value = F.substring_index(part, "\x02", 1)
        span = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(value)).alias("end"), value.alias("value")).cast(SPAN)
        return F.struct((acc["at"] + F.length(part) - 1).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def run(k: Column) -> Column:
        return F.aggregate(F.slice(parts, k * PIECES + 2, F.lit(PIECES)), F.struct(F.lit(0).alias("at"), none.alias("out")), take)

    runs = F.transform(F.sequence(F.lit(0), F.call_function("div", n - 1, F.lit(PIECES)).cast("int")), run)
    placed = F.aggregate(
        runs,
        F.struct(F.length(F.get(parts, 0)).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out")),
        lambda acc, r: F.struct(
            (acc["at"] + r["at"]).alias("at"),
            F.concat(
                acc["out"],
                F.array(F.transform(r["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value")).cast(SPAN))),
            ).alias("out"),
        ),
    )

    def before(i: Column) -> Column:
        pieces = F.slice(parts, F.greatest(i - NEIGHBOURS + 1, F.lit(0)) + 1, F.least(i + 1, F.lit(NEIGHBOURS)))
        return F.right(F.replace(F.array_join(F.transform(pieces, lambda p: F.right(p, F.lit(reach))), ""), F.lit("\x02"), F.lit("")), F.lit(reach))

    def behind(i: Column) -> Column:
        rest = F.substring_index(F.get(parts, i + 1), "\x02", -1)
        pieces = F.transform(F.slice(parts, i + 3, F.lit(NEIGHBOURS - 1)), lambda p: F.left(F.replace(p, F.lit("\x02"), F.lit("")), F.lit(reach)))
        return F.left(F.concat(F.left(rest, F.lit(reach)), F.array_join(pieces, "")), F.lit(reach))

    spans = F.transform(
        F.flatten(placed["out"]),
        lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), before(i).alias("left"), behind(i).alias("right")),
    )
    kind = "array<struct<start:int,end:int,value:string,left:string,right:string>>"
    return rows.withColumn(name, F.when(parts.isNotNull(), spans).otherwise(F.array().cast(kind))).drop("__parts")


def luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def cues(left: Column, right: Column) -> Column:
    """The last word and the last two words before a place, and the first and the first two behind it, which ``RIGHT`` marks."""
    left, right = F.lower(left), F.lower(right)
    found = F.array(
        F.regexp_extract(left, r"(\p{L}+)[^\p{L}]*$", 1), F.regexp_extract(left, r"(\p{L}+[^\p{L}]+\p{L}+)[^\p{L}]*$", 1),
        F.concat(F.lit(RIGHT), F.regexp_extract(right, r"^[^\p{L}]*(\p{L}+)", 1)), F.concat(F.lit(RIGHT), F.regexp_extract(right, r"^[^\p{L}]*(\p{L}+[^\p{L}]+\p{L}+)", 1)),
    )
    return F.filter(found, lambda c: ~c.isin("", RIGHT))


def nearest_word(cue: Column) -> Column:
    """The word of a cue that stands next to the place, with its mark."""
    first = F.concat(F.lit(RIGHT), F.regexp_extract(cue, r"^>(\p{L}+)", 1))
    return F.when(cue.startswith(RIGHT), first).otherwise(F.regexp_extract(cue, r"(\p{L}+)$", 1))


def base_spans(docs: DataFrame, id_col: str, text_col: str, reach: int) -> DataFrame:
    """(uid, id, one array of spans a kind, others): ``others`` are the other matches of
    ``TOKEN``, which could name somebody; all with their cues."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), text.alias("text"))
    for kind in KINDS:
        rows = with_spans(rows, f"raw_{kind}", PATTERNS[kind], reach)

    def checked(kind: str) -> Column:
        return F.filter(f"raw_{kind}", lambda s: holds(kind, s["value"]))

    for kind in KINDS:
        rows = rows.withColumn(kind, checked(kind))
    rows = with_spans(rows, "tokens", TOKEN, reach).withColumn("all", F.concat(*KINDS))
    # most tokens that are base matches begin with them, which a search among numbers tells at once
    rows = rows.withColumn("begins", F.transform("all", lambda s: s["start"]))
    free = F.filter(
        F.filter("tokens", lambda t: ~F.array_contains("begins", t["start"])),
        lambda t: ~F.exists("all", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])),
    )
    rows = rows.withColumn("others", free)

    def cued(name: str) -> Column:
        return F.transform(
            name,
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), cues(s["left"], s["right"]).alias("cues")),
        )

    return rows.select("uid", "id", *[cued(k).alias(k) for k in (*KINDS, "others")])


def scored_cues(edges: DataFrame, support: int, rounds: int) -> DataFrame:
    """(cue, kind, score) of the patterns of a pattern-instance graph of (kind, value, cue); kind is null for unseen values.

    A seed is worth 1 to its cues. An unseen value is worth, to a cue, the
    best score that a cue of another next word on the same side has: so a cue, the
    same one with a word more, and what stands around the same place, never
    back each other; another place has to. A cue's score is the mean worth
    of the distinct values that follow it; it has one once their worth sums up
    to ``support`` or more. In the first round only seeds are worth anything;
    in later ones values that are found induce cues that no seed follows.
    Distinct values are counted, so copies of a document add nothing, and all
    sums are combined before their shuffle.
    """
    word, side = nearest_word(F.col("cue")), F.col("cue").startswith(RIGHT)
    width = materialise(edges.groupBy("cue").agg(F.count_distinct("value").alias("width")), "widths")
    backed = edges.where("kind is not null").groupBy("cue", "kind").agg(F.count_distinct("value").cast("double").alias("backing"))
    backed = materialise(backed, "backing")
    open_ = materialise(edges.where("kind is null").select("value", "cue"), "open-edges")

    def scores_of(worth: DataFrame) -> DataFrame:
        rows = worth.groupBy("cue", "kind").agg(F.sum("backing").alias("backing")).where(F.col("backing") >= support)
        return materialise(rows.join(width, "cue").select("cue", "kind", (F.col("backing") / F.col("width")).alias("score")), "scores")

    scores = scores_of(backed)
    for _ in range(rounds):
        values = open_.join(scores, "cue").groupBy("value", "kind", side.alias("side"), word.alias("word")).agg(F.max("score").alias("score"))
        best = values.groupBy("value", "kind", "side").agg(F.max(F.struct("score", "word")).alias("best"))
        rest = values.join(best, ["value", "kind", "side"]).where(F.col("word") != F.col("best.word"))
        best = best.join(rest.groupBy("value", "kind", "side").agg(F.max("score").alias("next")), ["value", "kind", "side"], "left")
        worth = F.when(word == F.col("best.word"), F.coalesce("next", F.lit(0.0))).otherwise(F.col("best.score"))
        added = open_.withColumn("side", side).join(best, ["value", "side"]).select("cue", "kind", worth.alias("backing"))
        scores = scores_of(backed.unionByName(added))
    return scores


def discovered(rows: DataFrame, confidence: float, support: int, rounds: int) -> DataFrame:
    """(uid, found): spans of ``others`` that cues of ``confidence`` or more mark, as (kind, start, end)."""
    seen = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("spans")) for k in KINDS))).alias("x"))
    seen = seen.select("x.kind", F.explode("x.spans").alias("s"))
    free = rows.select(F.lit(None).cast("string").alias("kind"), F.explode("others").alias("s"))
    edges = seen.unionByName(free).select("kind", F.col("s.value").alias("value"), F.explode("s.cues").alias("cue"))
    edges = materialise(edges.where("cue <> ''").distinct(), "edges")
    scores = scored_cues(edges, support, rounds)
    good = scores.where(F.col("score") >= confidence).groupBy("cue").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    marks = rows.select("uid", F.explode("others").alias("s")).select(
        "uid", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.explode("s.cues").alias("cue")
    )
    marks = marks.join(good, "cue").groupBy("uid", "start", "end").agg(F.min("kind").alias("kind"))
    return marks.groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("found"))


def find_pii(
    docs: DataFrame,
    confidence: float = 0.9,
    support: int = 5,
    rounds: int = 3,
    reach: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, base, spans) for each row: arrays of (kind number, start, end) in order.

    ``base`` are the pattern matches that hold; ``spans`` also has what the
    bootstrapped cues found: other matches of ``TOKEN`` beside a cue, the last
    word or two words before a place or the first ones behind it, whose score is
    ``confidence`` or more (``scored_cues``). Cues are read from ``reach`` characters. Texts are read
    once; what follows works on spans.

    Defined cases: null and empty texts have no spans; repeated rows and null
    ids are handled one by one; long texts are searched whole; an empty table
    gives no rows; other columns are ignored.
    """
    rows = materialise(base_spans(docs, id_col, text_col, reach), "spans")
    more = discovered(rows, confidence, support, rounds)

    def numbered(kind: str) -> Column:
        number = F.lit(KINDS.index(kind))
        return F.transform(kind, lambda s: F.struct(number.alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    numbers = F.array(*map(F.lit, KINDS))
    added = F.transform(
        F.col("found"),
        lambda s: F.struct((F.array_position(numbers, s["kind"]) - 1).cast("int").alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    base = F.concat(*map(numbered, KINDS))
    return rows.join(more, "uid", "left").select(
        F.col("id").alias(id_col),
        base.alias("base"),
        F.sort_array(F.concat(base, F.coalesce(added, none))).alias("spans"),
    )


def spelled(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
