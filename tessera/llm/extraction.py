"""Main text of HTML pages by the distribution of text over line blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # a comment, or the rest of the page
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"([^\s/=\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption head html legend optgroup option tbody td tfoot th thead tr".split())
# an open element of the second kind ends where one of the first begins
SCOPES = frozenset("ul ol dl table td th article section main div aside nav footer header form blockquote figure".split())
PARTS = frozenset("article aside div footer form header main nav section".split())
LISTS, CELLS = frozenset("ul ol dl menu table".split()), frozenset(("table",))
IMPLIED = {
    "li": (("li",), LISTS), "dt": (("dt", "dd"), LISTS), "dd": (("dt", "dd"), LISTS), "option": (("option",), LISTS),
    "tr": (("tr",), CELLS), "td": (("td", "th"), CELLS | {"tr"}), "th": (("td", "th"), CELLS | {"tr"}),
}
CLOSED_WHOLE = frozenset("html body main article table td th".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
# elements whose text is never the article's
DROPPED = frozenset("aside audio button canvas datalist dialog embed form frameset head iframe input label map math menu meter nav noembed noframes noscript object progress script search select style svg template textarea title video".split())
DROPPED_ROLES = frozenset("alert alertdialog banner button complementary contentinfo dialog form listbox menu menubar navigation note search status tablist toolbar tooltip".split())
# words of class and id names, between blanks, hyphens, underscores and humps
DROPPED_NAMES = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising adv banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright disqus footer gdpr login masthead menu menus menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup "
    "popups promo promotion promoted related reply replies respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toc toolbar widget widgets".split()
)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
STATES = frozenset("has with no without is show hide sticky fixed".split())  # a name with one of these tells of a state, not of a part
HEADERS = frozenset("header topbar".split())  # outside an article
TELLING = re.compile("class|id|role|style", re.I)


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTR.finditer(text):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


def named(attrs: dict[str, str]) -> set[str]:
    """Words of the class and id names, without names of states."""
    found: set[str] = set()
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = {w.lower() for w in NAME_WORD.findall(name)}
        if not words & STATES:
            found |= words
    return found


class Lines:
    """Markup stripped to lines: each tag of a block stands on a line of its own, which is empty then.

    The end of a part of the page that holds blocks leaves one more empty line.

    ``texts`` holds the text of each line, ``plain`` its length outside links,
    ``heads`` whether it is a heading, and ``boxes`` the number of the article
    around it, or of the main element where no article is, and 0 outside. Text
    of the dropped kinds leaves no line; ``by_name`` drops by class and id too.
    """

    def __init__(self, html: str, by_name: bool = True):
        self.by_name = by_name
        self.texts: list[str] = []
        self.plain: list[int] = []
        self.heads: list[bool] = []
        self.boxes: list[int] = []
        self.part: list[tuple[str, bool]] = []
        # open elements: name, whether its text is dropped, whether it is in a link, its box, whether that is an article
        self.open: list[tuple[str, bool, bool, int, bool]] = []
        self.here = ("", False, False, 0, False)
        self.holds: list[bool] = []  # whether an open element holds blocks
        self.n_boxes = 0
        at = 0
        while m := TAG.search(html, at):
            if m.start() > at:
                self.add(html[at : m.start()])
            at = m.end()
            if not m["name"]:
                continue
            name = m["name"].lower()
            if m["end"]:
                self.close(name)
                continue
            self.start(name, attributes(m["attrs"]) if TELLING.search(m["attrs"]) else {})
            if name in RAW:
                end = RAW[name].search(html, at)
                at = end.start() if end else len(html)
            elif name == "plaintext":
                break
        self.add(html[at:])
        self.end_line()

    def add(self, text: str) -> None:
        if not self.here[1]:
            self.part.append((text, self.here[2]))

    def end_line(self) -> None:
        text, plain = "", 0
        if self.part:
            text = " ".join(unescape("".join([t for t, _ in self.part])).split())
            linked = any(link for _, link in self.part)
            plain = len(" ".join(unescape("".join([" " if link else t for t, link in self.part])).split())) if linked else len(text)
            self.part = []
        self.texts.append(text)
        self.plain.append(plain)
        self.heads.append(self.here[0] in HEADINGS)
        self.boxes.append(self.here[3])

    def drops(self, name: str, attrs: dict[str, str], box: int) -> bool:
        if name in DROPPED or name == "footer" or (name == "header" and not box):
            return True
        if not attrs:
            return False
        if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attrs.get("style", "")):
            return True
        if name in ("html", "body", "main"):
            return False
        words = named(attrs) if self.by_name else set()
        return attrs.get("role", "").lower() in DROPPED_ROLES or bool(words & DROPPED_NAMES) or (not box and bool(words & HEADERS))

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if name in CLOSES_P:
            self.end_implied(("p",), SCOPES)
        if name in IMPLIED:
            self.end_implied(*IMPLIED[name])
        if name in BLOCKS:
            self.end_line()
            if self.holds:
                self.holds[-1] = True
        if name == "br":
            self.add(" ")
        if name in VOID:
            return
        _, dropped, link, box, article = self.here
        dropped = dropped or self.drops(name, attrs, box)
        role = attrs.get("role", "").lower()
        if not dropped and not article and (name in MAIN or role in MAIN):
            self.n_boxes += 1
            box, article = self.n_boxes, "article" in (name, role)
        self.here = (name, dropped, link or name == "a", box, article)
        self.open.append(self.here)
        self.holds.append(False)

    def cut(self, i: int) -> None:
        if self.holds[i] and self.open[i][0] in PARTS:
            self.end_line()
        del self.open[i:], self.holds[i:]
        self.here = self.open[-1] if self.open else ("", False, False, 0, False)

    def end_implied(self, names: tuple[str, ...], scopes: frozenset[str]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                self.end_line()
                return self.cut(i)
            if self.open[i][0] in scopes:
                return None
        return None

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.end_line()
        for i in range(len(self.open) - 1, -1, -1):
            here = self.open[i][0]
            if here == name or (name in HEADINGS and here in HEADINGS):
                return self.cut(i)
            # a stray end of an inline element, or of a part outside its cell or article
            if (name not in BLOCKS and here in BLOCKS) or (here in CLOSED_WHOLE and name not in CLOSED_WHOLE):
                return None
        return None


def main_lines(lines: Lines, window: int = 3, dense: int = 80) -> list[str]:
    """The lines of the main text.

    A line block is ``window`` lines, and weighs the characters of its lines
    outside links. Text runs from a surge, where blocks rise from nothing, to a
    dive, where they fall to nothing again. The heaviest run is main text; an
    article or main element around it moves the surge to its start and the dive
    to its end. Without one, other runs with a block of ``dense`` characters
    are main text too, and headings right before such runs.
    """
    plain = np.array(lines.plain, np.int64)
    if not plain.any():
        plain = np.array([len(t) for t in lines.texts], np.int64)  # all text is in links
    if not plain.any():
        return []
    total = np.concatenate(([0], np.cumsum(plain)))
    blocks = total[np.minimum(np.arange(len(plain)) + window, len(plain))] - total[:-1]
    some = np.concatenate(([False], blocks > 0, [False]))
    surges, dives = np.flatnonzero(~some[:-1] & some[1:]), np.flatnonzero(some[:-1] & ~some[1:])
    full = np.flatnonzero(plain)
    # of each run, the places of its first and behind its last line with text
    firsts = full[np.searchsorted(full, surges)]
    lasts = full[np.searchsorted(full, np.minimum(dives + window - 1, len(plain))) - 1] + 1
    heaviest = int(np.argmax(total[lasts] - total[firsts]))
    boxes = np.array(lines.boxes)
    run = slice(firsts[heaviest], lasts[heaviest])
    inside = np.bincount(boxes[run], plain[run])
    box = int(np.argmax(inside[1:])) + 1 if len(inside) > 1 else 0
    if box and inside[box] >= inside[0]:
        keep = boxes == box
    else:
        heads, keep, after = np.array(lines.heads), np.zeros(len(plain), bool), False
        for k in range(len(surges) - 1, -1, -1):
            run = slice(firsts[k], lasts[k])
            after = k == heaviest or bool(blocks[surges[k] : dives[k]].max() >= dense) or (after and bool(heads[run][plain[run] > 0].all()))
            keep[run] = after
    return [t for t, k in zip(lines.texts, keep, strict=True) if k and t]


def extract_text(html: str | None, window: int = 3, dense: int = 80) -> str:
    """The main text of a page, a block a line."""
    if not html:
        return ""
    found = main_lines(Lines(html), window, dense) or main_lines(Lines(html, by_name=False), window, dense)
    return "\n".join(found)


def extract_pages(pages: DataFrame, window: int = 3, dense: int = 80, html_col: str = "html") -> DataFrame:
    """The columns of ``pages`` but for the html, with ``text`` and ``n_chars``, its code points.

    Pages are read where they lie, one at a time, and in whole. Scripts,
    styles, forms, menus, page headers, footers, sidebars, notices, adverts and
    comments are told by their elements, roles and names and leave no line;
    ``main_lines`` finds the text among the others. A block's white space
    becomes one space, a line break in it too; character references are decoded.

    Defined cases: null and empty pages, and pages without text, give an empty
    text; broken markup is read as far as it goes: unclosed elements end with
    their parents, stray ends are skipped, a comment, script or tag that nothing closes
    takes the rest of the page; repeated rows are extracted one by one; other
    columns, null or not, pass through, and one called text or n_chars gives way;
    of equally heavy runs the first counts; an empty table gives no rows.
    """
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract_text(h.as_py(), window, dense) for h in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*(f"c{i}" for i in range(len(others))), "text", "n_chars"],
            )

    source = pages.select(F.col(f"`{html_col}`").alias("html"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    schema = StructType([*source.schema[1:], StructField("text", StringType()), StructField("n_chars", LongType())])
    return source.mapInArrow(run, schema).toDF(*others, "text", "n_chars")
