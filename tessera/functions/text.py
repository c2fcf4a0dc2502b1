"""Scalar functions of the engine as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.fixed import COMMON_PASSWORDS


def rounded(x: Column, digits: int = 0) -> Column:
    """Half up towards plus infinity, as doubles (integers for no digits)."""
    scale = 10**digits
    whole = F.floor(x * scale + 0.5)
    return whole.cast("int") if digits == 0 else whole.cast("double") / scale


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def shortened(text: Column, most: int = 160) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def escaped(text: Column) -> Column:
    """HTML text with its five special characters spelled out."""
    for raw, spelled in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(spelled))
    return text


def slug(text: Column, most: int = 40) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most))


def url_path(url: Column) -> Column:
    """The path of an absolute url, / where it is empty; the url itself if it has no host."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.when(host == "", url).otherwise(F.when(path == "", "/").otherwise(path))


def path_of(url: Column) -> Column:
    """``url_path`` less one slash at its end, but never empty."""
    path = F.regexp_replace(url_path(url), "/$", "")
    return F.when(path == "", "/").otherwise(F.when(url_path(url) == url, url).otherwise(path))


def path_shape(url: Column) -> Column:
    """Path segments, with numbers and segments of over 24 characters as :id."""
    parts = F.filter(F.split(F.split_part(F.split_part(url_path(url), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "/"), lambda s: s != "")
    named = F.transform(parts, lambda s: F.when(s.rlike(r"^\d+$") | (F.length(s) > 24), ":id").otherwise(s))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def short_url(url: Column) -> Column:
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.concat(url_path(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def signature(rule: Column, url: Column, selector: Column, key: Column) -> Column:
    """Twenty hex digits that name a finding across scans; host and query do not matter."""
    none = F.lit("")
    parts = (rule, url_path(F.coalesce(url, none)), selector, key)
    return F.left(F.sha1(F.concat_ws("|", *(F.coalesce(p, none) for p in parts))), F.lit(20))


def score_band(score: Column) -> Column:
    return F.when(score >= 90, "good").when(score >= 70, "fair").when(score >= 50, "poor").otherwise("bad")


def lead_band(score: Column) -> Column:
    score = F.coalesce(score, F.lit(0))
    return F.when(score >= 70, "good").when(score >= 40, "fair").otherwise("bad")


def private_host(host: Column) -> Column:
    """Hosts of local or private networks, and names that never leave one."""
    name = F.regexp_replace(F.lower(F.trim(host)), r"^\[|\]$|\.$", "")
    mapped = F.regexp_extract(name, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    four = F.split(F.when(mapped != "", mapped).otherwise(name), r"\.")
    a, b = F.try_to_number(F.get(four, 0), F.lit("999")), F.try_to_number(F.get(four, 1), F.lit("999"))
    dotted = F.when(mapped != "", mapped).otherwise(name).rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    inside = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19))
    )
    names = name.rlike(r"^(localhost|.*\.localhost|.*\.local|.*\.internal|.*\.lan|metadata|)$")
    six = name.contains(":") & name.rlike(r"^(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$")
    return names | six | (dotted & F.coalesce(inside, F.lit(False)))


def icon_name(classes: Column, names: list[tuple[str, str]]) -> Column:
    """The first control name whose words stand in a list of class names."""
    found = F.lit(None).cast("string")
    for words, label in reversed(names):
        found = F.when(classes.rlike(rf"(?i)\b({words})\b"), label).otherwise(found)
    return found


def short_date(at: Column) -> Column:
    return F.date_format(at, "MMM d, yyyy")


def long_date(at: Column) -> Column:
    return F.date_format(at, "MMMM d, yyyy")


def relative_time(at: Column, now: Column) -> Column:
    """Rough words for the distance between two times, past or to come; a date beyond 30 days."""
    millis = F.unix_millis(now.cast("timestamp")) - F.unix_millis(at.cast("timestamp"))
    minutes = rounded(F.abs(millis) / 60_000)
    hours = rounded(minutes / 60)
    days = rounded(hours / 24)
    later = millis < 0

    def phrase(n: Column, unit: str) -> Column:
        value = F.concat(n.cast("string"), F.lit(unit))
        return F.when(later, F.concat(F.lit("in "), value)).otherwise(F.concat(value, F.lit(" ago")))

    return (
        F.when(at.isNull(), "never")
        .when(minutes < 1, F.when(later, "in under a minute").otherwise("just now"))
        .when(minutes < 60, phrase(minutes, "m"))
        .when(hours < 24, phrase(hours, "h"))
        .when(days < 30, phrase(days, "d"))
        .otherwise(short_date(at))
    )


def days_left(ends: Column, now: Column) -> Column:
    """Whole days until a trial ends, rounded up, 0 once it is over; null without a trial."""
    days = F.ceil((F.unix_millis(ends.cast("timestamp")) - F.unix_millis(now.cast("timestamp"))) / 86_400_000)
    return F.when(ends.isNotNull(), F.greatest(days, F.lit(0)).cast("int"))


def plural(n: Column, word: str) -> Column:
    """The number and its word, with an s unless it is one."""
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def patch_filename(url: Column) -> Column:
    """The path without its first slash, index.html where that is empty."""
    name = F.regexp_replace(url_path(url), "^/", "")
    return F.when(name == "", "index.html").otherwise(name)


def diff_class(line: Column) -> Column:
    """What a line of a unified diff is: meta, add, del or ctx."""
    meta = line.startswith("+++") | line.startswith("---") | line.startswith("@@")
    return F.when(meta, "meta").when(line.startswith("+"), "add").when(line.startswith("-"), "del").otherwise("ctx")


def valid_email(address: Column) -> Column:
    return F.coalesce(address.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"), F.lit(False))


def password_fault(password: Column) -> Column:
    """Why a password is refused: short, long or common; null if it is not."""
    n = F.length(F.coalesce(password, F.lit("")))
    return F.when(n < 10, "short").when(n > 200, "long").when(F.lower(password).isin(*COMMON_PASSWORDS), "common")
