"""HTML documents as tables of elements."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.fixed import ICON_NAMES, INPUT_ROLES, TAG_ROLES

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
UNSEEN = frozenset("script style noscript template head meta link title base".split())
FOCUSABLE = frozenset("a button input select textarea summary audio video details iframe".split())
NAMED_BY_CONTENT = frozenset("button a h1 h2 h3 h4 h5 h6 summary td th legend caption option".split())
# an opening tag of the set ends an open element of the key, up to one of the stops
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    **dict.fromkeys(
        "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(),
        ({"p"}, {"button", "td", "th", "li", "body"}),
    ),
}
# parts of a table stand in one another; where one is missing it is implied
SECTIONS, CELLS = frozenset("tbody thead tfoot".split()), frozenset(("td", "th"))
TABLE_PARTS = SECTIONS | CELLS | {"caption", "colgroup", "col", "tr"}
# what may stand between the parts of a table; all else goes before the table
TABLE_GUESTS = frozenset("form script style template".split())
COLLAPSE = re.compile(r"\s+")


def collapsed(text: str) -> str:
    return COLLAPSE.sub(" ", text).strip()


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "line", "col", "start", "end", "close", "hidden", "deep", "number", "place")

    def __init__(self, tag, attrs=(), parent=None, line=None, col=None, start=None, end=None):
        self.tag, self.parent, self.kids = tag, parent, []
        self.attrs: dict[str, str] = {}
        for name, value in attrs:
            self.attrs.setdefault(name.lower(), value or "")
        self.line, self.col, self.start, self.end, self.close = line, col, start, end, end
        self.place = 0
        style = COLLAPSE.sub("", self.attrs.get("style", "").lower())
        self.hidden = (
            "hidden" in self.attrs
            or self.attrs.get("aria-hidden") == "true"
            or (tag == "input" and self.attrs.get("type", "").lower() == "hidden")
            or "display:none" in style
            or "visibility:hidden" in style
        )
        self.deep = self.hidden or (parent is not None and parent.deep)
        if parent is not None:
            parent.kids.append(self)

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]

    def walk(self) -> Iterator[Node]:
        """This element and those below, in document order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.elements()))

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None and node.tag != "#document":
            yield node
            node = node.parent


class TreeBuilder(HTMLParser):
    """A tree with html, head and body always there, tolerant of bad nesting."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.html = Node("html", parent=self.root)
        self.head = self.body = None
        self.open = [self.html]
        self.starts = [0]
        for m in re.finditer("\n", html):
            self.starts.append(m.end())
        self.feed(html)
        self.close()
        if self.head is None:
            self.head = Node("head", parent=self.html)
            self.html.kids.insert(0, self.html.kids.pop())
        if self.body is None:
            self.body = Node("body", parent=self.html)

    def _at(self) -> tuple[int, int, int]:
        line, col = self.getpos()
        return line, col + 1, self.starts[line - 1] + col

    def _section(self, tag: str) -> None:
        """Opens the head or the body that a tag needs."""
        if self.body is None:
            if tag in HEAD_TAGS:
                if self.head is None:
                    self.head = Node("head", parent=self.html)
                    self.open = [self.html, self.head]
                elif len(self.open) == 1:
                    self.open = [self.html, self.head]
            elif len(self.open) <= 2:
                if self.head is None:
                    self.head = Node("head", parent=self.html)
                self.body = Node("body", parent=self.html)
                self.open = [self.html, self.body]

    def handle_starttag(self, tag, attrs, closed=False):
        line, col, start = self._at()
        end = start + len(self.get_starttag_text())
        if tag in ("html", "head", "body"):
            node = {"html": self.html, "head": self.head, "body": self.body}[tag]
            if node is None:
                node = Node(tag, attrs, self.html)
                setattr(self, tag, node)
                if tag == "body" and self.head is None:
                    self.head = Node("head", parent=self.html)
                    self.html.kids = [self.head, node]
                self.open = [self.html, node]
            else:
                fresh = Node(tag, attrs)
                for name, value in fresh.attrs.items():
                    node.attrs.setdefault(name, value)
                node.hidden = node.hidden or fresh.hidden
                node.deep = node.deep or fresh.hidden
            if node.start is None:
                node.line, node.col, node.start, node.end = line, col, start, end
            return
        self._section(tag)
        if tag in TABLE_PARTS and not self._table_part(tag):
            return
        ends, stops = CLOSED_BY.get(tag, ((), ()))
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag in ends:
                del self.open[i:]
                break
            elif self.open[i].tag in stops:
                break
        node = Node(tag, attrs, self.open[-1], line, col, start, end)
        if tag not in TABLE_PARTS and tag not in TABLE_GUESTS and not (tag == "input" and node.hidden):
            self._foster(node)
        if tag not in VOID and not closed:
            self.open.append(node)

    def _within(self, tags: frozenset[str] | set[str]) -> int:
        """The place of the last open element of ``tags`` inside the innermost table, or 0."""
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag in tags:
                return i
            if self.open[i].tag == "table":
                break
        return 0

    def _table_part(self, tag: str) -> bool:
        """Makes the open elements end where a part of a table belongs; False outside tables, where parts are ignored."""
        table = next((i for i in range(len(self.open) - 1, 1, -1) if self.open[i].tag == "table"), 0)
        if not table:
            return False
        if tag == "tr" or tag in CELLS:
            section = self._within(SECTIONS)
            row = self._within({"tr"}) if tag != "tr" else 0
            del self.open[(row or section or table) + 1 :]
            if not section and not row:
                self.open.append(Node("tbody", parent=self.open[-1]))
            if tag != "tr" and not row:
                self.open.append(Node("tr", parent=self.open[-1]))
        elif tag == "col":
            group = self._within({"colgroup"})
            del self.open[(group or table) + 1 :]
            if not group:
                self.open.append(Node("colgroup", parent=self.open[-1]))
        else:
            del self.open[table + 1 :]
        return True

    def _foster(self, item: Node | str) -> bool:
        """Moves what was put between the parts of a table before the table."""
        if self.open[-1].tag not in SECTIONS | {"table", "tr"}:
            return False
        table = next(n for n in reversed(self.open) if n.tag == "table")
        if isinstance(item, Node):
            item.parent.kids.pop()
            item.parent = table.parent
            item.deep = item.hidden or table.parent.deep
        kids = table.parent.kids
        kids.insert(next(i for i, k in enumerate(kids) if k is table), item)
        return True

    def handle_startendtag(self, tag, attrs):
        # a slash closes foreign elements only
        self.handle_starttag(tag, attrs, any(n.tag in ("svg", "math") for n in self.open) or tag == "svg")

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.head is not None and self.body is None:
                self.open = [self.html]
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == "table" and tag in TABLE_PARTS:
                return  # an outer table's part does not end inside this one
            if self.open[i].tag == tag and self.open[i] is not self.body:
                self.open[i].close = self._at()[2] + len(tag) + 3
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.body is None and len(self.open) <= 2 and self.open[-1].tag in ("html", "head"):
            if not data.strip():
                return
            self._section("#text")
        if not data.strip() or not self._foster(data):
            self.open[-1].kids.append(data)


def text_of(node: Node, hidden: bool = False) -> str:
    """Text of a subtree; rules of exclusion hold below ``node`` only; images give their alt."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        if n is not node and (n.tag in UNSEEN or (n.hidden and not hidden)):
            continue
        if n.tag == "img":
            if n.attrs.get("alt"):
                out.append(f" {n.attrs['alt']} ")
            continue
        stack.extend(reversed(n.kids))
    return collapsed("".join(out))


def focusable(node: Node) -> bool:
    a, tab = node.attrs, node.attrs.get("tabindex")
    if tab is not None:
        return tab != "-1"
    if node.tag in ("a", "area"):
        return "href" in a
    if node.tag == "input":
        return a.get("type", "").lower() != "hidden" and "disabled" not in a
    if node.tag in FOCUSABLE:
        return "disabled" not in a
    return "contenteditable" in a and a["contenteditable"] != "false"


def implicit_role(node: Node) -> str | None:
    if node.tag in ("a", "area"):
        return "link" if "href" in node.attrs else None
    if node.tag == "input":
        return INPUT_ROLES.get((node.attrs.get("type") or "text").lower())
    return TAG_ROLES.get(node.tag)


class Document:
    """A parsed page with its lookups by id and by label target."""

    def __init__(self, html: str):
        self.root = TreeBuilder(html).root
        self.nodes = [n for n in self.root.walk() if n.tag != "#document"]
        self.by_id: dict[str, Node] = {}
        self.labels: dict[str, Node] = {}
        for i, n in enumerate(self.nodes):
            n.number = i
            kids = n.elements()
            same, nth = Counter(k.tag for k in kids), Counter()
            for k in kids:
                nth[k.tag] += 1
                # the place among siblings of the same tag, where there are several
                k.place = nth[k.tag] if same[k.tag] > 1 else 0
            if n.attrs.get("id"):
                self.by_id.setdefault(n.attrs["id"], n)
            if n.tag == "label" and n.attrs.get("for"):
                self.labels.setdefault(n.attrs["for"], n)

    def referenced(self, ids: str) -> list[str]:
        return [text_of(self.by_id[i], True) for i in ids.split() if i in self.by_id]

    def content_name(self, node: Node, depth: int = 0) -> str:
        if depth > 5:
            return ""
        parts = []
        for k in node.kids:
            if isinstance(k, str):
                parts.append(k)
                continue
            if k.tag in UNSEEN or k.hidden:
                continue
            a = k.attrs
            if a.get("aria-labelledby") and (names := self.referenced(a["aria-labelledby"])):
                parts.append(" ".join(names))
            elif a.get("aria-label", "").strip():
                parts.append(a["aria-label"].strip())
            elif k.tag in ("img", "area"):
                parts.append(a.get("alt", ""))
            elif k.tag == "svg":
                parts.extend(text_of(t, True) for t in k.elements()[:] if t.tag == "title")
            elif k.tag == "input":
                if (a.get("type") or "text").lower() in ("submit", "button", "reset"):
                    parts.append(a.get("value", ""))
            else:
                parts.append(self.content_name(k, depth + 1))
        return collapsed(" ".join(parts))

    def name(self, node: Node) -> tuple[str, str | None]:
        """Accessible name and where it comes from."""
        a, tag = node.attrs, node.tag
        if a.get("aria-labelledby") and (names := [n for n in self.referenced(a["aria-labelledby"]) if n]):
            return " ".join(names), "aria-labelledby"
        if a.get("aria-label", "").strip():
            return a["aria-label"].strip(), "aria-label"
        if tag in ("img", "area") and "alt" in a:
            return a["alt"].strip(), "alt"
        if tag == "input":
            kind = (a.get("type") or "text").lower()
            if kind in ("submit", "button", "reset"):
                if a.get("value", "").strip():
                    return a["value"].strip(), "value"
                if kind != "button":
                    return kind.capitalize(), "implicit"
            if kind == "image" and a.get("alt", "").strip():
                return a["alt"].strip(), "alt"
        if tag in ("input", "select", "textarea"):
            label = self.labels.get(a.get("id", ""))
            if label is not None and (text := text_of(label, True)):
                return text, "label-for"
            label = next((n for n in node.ancestors() if n.tag == "label"), None)
            if label is not None and (text := text_of(label, True)):
                return text, "label-wrap"
        first = {k.tag: k for k in reversed(node.elements())}
        if tag == "svg" and "title" in first and (text := text_of(first["title"], True)):
            return text, "svg-title"
        if tag == "fieldset" and "legend" in first:
            return text_of(first["legend"]), "legend"
        if tag == "table" and "caption" in first:
            return text_of(first["caption"]), "caption"
        if tag in NAMED_BY_CONTENT and (text := self.content_name(node)):
            return text, "contents"
        if a.get("title", "").strip():
            return a["title"].strip(), "title"
        return "", None


def css_path(node: Node) -> str:
    parts, n = [], node
    while n is not None and n.tag not in ("#document", "html"):
        if re.fullmatch(r"[A-Za-z][\w-]*", n.attrs.get("id", ""), re.ASCII):
            parts.append(f"#{n.attrs['id']}")
            break
        parts.append(n.tag + (f":nth-of-type({n.place})" if n.place else ""))
        n = n.parent
    return " > ".join(reversed(parts)) or node.tag


def table_facts(node: Node) -> tuple[dict[str, str], Node | None]:
    """Rows of a table and those with header cells; and the first header cell without a scope, where headers run both ways."""
    rows = [n for n in node.walk() if n.tag == "tr"]
    heads = [any(k.tag == "th" for k in r.elements()) for r in rows]
    bare = None
    if any(heads[:1]) and any(heads[1:]):
        bare = next((n for n in node.walk() if n.tag == "th" and "scope" not in n.attrs and "headers" not in n.attrs), None)
    return {"rows": str(len(rows)), "head_rows": str(sum(heads))}, bare


def echoes(node: Node) -> Iterator[Node]:
    """The images inside a link whose alt repeats the link's own text."""
    own = collapsed(" ".join(k for k in node.kids if isinstance(k, str))).lower()
    if own:
        for n in node.walk():
            if n.tag == "img" and n.attrs.get("alt", "").strip().lower() == own:
                yield n


def marks(doc: Document) -> tuple[dict[int, dict[str, str]], Counter, Counter]:
    """Facts of tables; how many visible tables miss a scope on a header cell, and how many visible links an image repeats."""
    tables, scopes, images = {}, Counter(), Counter()
    for n in doc.nodes:
        if n.tag == "table":
            tables[n.number], bare = table_facts(n)
            if bare is not None and not n.deep:
                scopes[bare.number] += 1
        elif n.tag == "a" and not n.deep:
            images.update(k.number for k in echoes(n))
    return tables, scopes, images


ELEMENT = pa.schema(
    [
        ("node_id", pa.int32()), ("parent_id", pa.int32()), ("last_id", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())), ("line", pa.int32()), ("col", pa.int32()),
        ("start_off", pa.int32()), ("end_off", pa.int32()), ("elem_end_off", pa.int32()),
        ("own_text", pa.string()), ("text", pa.string()), ("text_all", pa.string()),
        ("hidden", pa.bool_()), ("hidden_deep", pa.bool_()), ("focusable", pa.bool_()),
        ("role_implicit", pa.string()), ("role", pa.string()), ("acc_name", pa.string()), ("acc_source", pa.string()),
        ("css_path", pa.string()), ("snippet", pa.string()),
        ("ancestors", pa.list_(pa.struct([("node_id", pa.int32()), ("tag", pa.string()), ("role", pa.string()), ("href", pa.bool_()), ("named", pa.bool_()), ("legend", pa.bool_())]))),
        ("kids", pa.list_(pa.struct([("tag", pa.string()), ("kind", pa.string())]))),
        ("stray_text", pa.bool_()), ("holds_focusable", pa.bool_()), ("classes", pa.string()),
        ("facts", pa.map_(pa.string(), pa.string())),
    ]
)
ELEMENT_DDL = (
    "node_id int, parent_id int, last_id int, depth int, tag string, attrs map<string,string>, line int, col int,"
    " start_off int, end_off int, elem_end_off int, own_text string, text string, text_all string,"
    " hidden boolean, hidden_deep boolean, focusable boolean, role_implicit string, role string,"
    " acc_name string, acc_source string, css_path string, snippet string,"
    " ancestors array<struct<node_id:int,tag:string,role:string,href:boolean,named:boolean,legend:boolean>>,"
    " kids array<struct<tag:string,kind:string>>, stray_text boolean, holds_focusable boolean,"
    " classes string, facts map<string,string>"
)
ICONS = [(re.compile(rf"\b({words})\b", re.IGNORECASE | re.ASCII), words.split("|")[0]) for words, _ in ICON_NAMES]
BATCH_ROWS = 1000  # elements from which on a batch is given out
# tags whose text no rule and no report reads
BULKY = frozenset("html head body div main section article".split())


def element_rows(html: str, linked: str = "") -> Iterator[dict]:
    """The rows of one document, in document order; ``linked`` is the text of its linked style sheets.

    The root's facts hold that text, and how many color rules could not be read.
    """
    from .css import text_styles

    doc = Document(html)
    focus = [False] * len(doc.nodes)
    icons = [len(ICONS)] * len(doc.nodes)
    last = [0] * len(doc.nodes)  # the last element inside each: those from an element to its last are its subtree
    for n in reversed(doc.nodes):
        inner = [k.number for k in n.elements()]
        last[n.number] = last[inner[-1]] if inner else n.number
        focus[n.number] = focusable(n) or any(focus[i] for i in inner)
        own = " ".join(n.attrs[k] for k in ("class", "id", "data-icon") if n.attrs.get(k))
        # of the class names of a whole subtree only the first icon that they name matters
        first = next((k for k, (pattern, _) in enumerate(ICONS) if pattern.search(own)), len(ICONS)) if own else len(ICONS)
        icons[n.number] = min([first, *(icons[i] for i in inner)])
    legend = {n.number: bool(next((text_of(k) for k in n.elements() if k.tag == "legend"), "")) for n in doc.nodes if n.tag == "fieldset"}
    tables, scopes, images = marks(doc)
    names = [doc.name(n) for n in doc.nodes]
    styles, unreadable = text_styles(doc, linked)
    # what the elements inside say of one that is around them: (node_id, tag, role, href, named, legend)
    shown = [(n.number, n.tag, n.attrs.get("role"), "href" in n.attrs, bool(names[n.number][0]), legend.get(n.number, False)) for n in doc.nodes]
    around: list[list[tuple]] = []
    for n in doc.nodes:
        above = n.parent.number if n.parent.tag != "#document" else None
        around.append([] if above is None else [shown[above], *around[above]])
        explicit = n.attrs.get("role")
        role = implicit_role(n)
        facts = styles.get(n.number, {})
        if n.tag == "table":
            facts = facts | tables[n.number]
        elif scopes[n.number]:
            facts = facts | {"lacks_scope": str(scopes[n.number])}
        elif images[n.number]:
            facts = facts | {"echoes": str(images[n.number])}
        elif n.tag == "audio":
            facts = facts | {"transcript": str("transcript" in text_of(n.parent).lower()).lower()}
        elif n.tag == "html":
            facts = facts | {"linked": linked, "unreadable": str(unreadable)}
        elif n.tag == "body":
            facts = facts | {"chars": str(len(text_of(n)))}
        source = "" if n.start is None else collapsed(html[n.start : n.end])
        yield {
            "node_id": n.number,
            "parent_id": above,
            "last_id": last[n.number],
            "depth": len(around[n.number]),
            "tag": n.tag,
            "attrs": list(n.attrs.items()),
            "line": n.line, "col": n.col, "start_off": n.start, "end_off": n.end, "elem_end_off": n.close,
            "own_text": collapsed("".join(k for k in n.kids if isinstance(k, str))),
            "text": None if n.tag in BULKY else text_of(n),
            "text_all": text_of(n, True) if n.tag in ("a", "label", "title", "legend", "style") else None,
            "hidden": n.hidden, "hidden_deep": n.deep, "focusable": focusable(n),
            "role_implicit": role,
            "role": explicit.strip().split()[0].lower() if explicit and explicit.strip() else role,
            "acc_name": names[n.number][0], "acc_source": names[n.number][1],
            "css_path": css_path(n),
            "snippet": (source[:159] + "…" if len(source) > 160 else source) or f"<{n.tag}>",
            "ancestors": around[n.number],
            "kids": [(k.tag, k.attrs.get("kind", "").lower()) for k in n.elements()],
            "stray_text": any(isinstance(k, str) and k.strip() for k in n.kids),
            "holds_focusable": focus[n.number],
            "classes": ICONS[icons[n.number]][1] if icons[n.number] < len(ICONS) else "",
            "facts": list(facts.items()),
        }


def html_elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", css_col: str | None = None) -> DataFrame:
    """One row an element of every page, in document order within the page.

    Pages are parsed where they lie, in Arrow batches, without a shuffle.
    ``css_col`` names the text of a page's linked style sheets (see
    ``sheets.with_linked_css``). Defined cases: null and blank documents have
    no rows; null style sheets are empty.
    """
    kind = pages.select(id_col).schema[0].dataType

    def batch(ids: list, rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array([r[f.name] for r in rows], f.type) for f in ELEMENT]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *columns], ["page_id", *ELEMENT.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # small pages share a batch, as each batch has a cost of its own
            ids, rows, kind = [], [], b.schema.field(0).type
            for page, value, css in zip(b.column(0), b.column(1), b.column(2), strict=True):
                html = value.as_py()
                if html is None or not html.strip():
                    continue
                known = len(rows)
                rows.extend(element_rows(html, css.as_py() or ""))
                ids += [page.as_py()] * (len(rows) - known)
                if len(rows) >= BATCH_ROWS:
                    yield batch(ids, rows, kind)
                    ids, rows = [], []
            if rows:
                yield batch(ids, rows, kind)

    css = F.col(css_col).cast("string") if css_col else F.lit(None).cast("string")
    source = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string"), css.alias("css"))
    return source.mapInArrow(run, f"page_id {kind.simpleString()}, {ELEMENT_DDL}")


def run_rows(html: str) -> Iterator[tuple[int, int, int, str]]:
    doc = Document(html)
    last = [0] * len(doc.nodes)
    for n in reversed(doc.nodes):
        inner = n.elements()
        last[n.number] = last[inner[-1].number] if inner else n.number
    for n in doc.nodes:
        after = n.number
        for nth, k in enumerate(n.kids):
            if isinstance(k, str):
                yield n.number, after, nth, k
            else:
                after = last[k.number]


def text_runs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, node_id, after, nth, text): each run of text, as it stands, with the element that holds it.

    ``after`` is the last element that begins before the run. By (after, -node_id,
    nth) the runs of a page are in document order, as of those behind the same
    element the ones inside come first. Defined cases are those of ``html_elements``.
    """
    kind = pages.select(id_col).schema[0].dataType
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page, value in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if value is None or not value.strip():
                    continue
                columns = list(zip(*run_rows(value), strict=True)) or [()] * 4
                ids = pa.array([page.as_py()] * len(columns[0]), b.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns, kinds)], ["page_id", "node_id", "after", "nth", "text"])

    source = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string"))
    return source.mapInArrow(run, f"page_id {kind.simpleString()}, node_id int, after int, nth int, text string")



def of_tags(elements: DataFrame, *tags: str) -> DataFrame:
    """Elements of the given tags with their ``place`` in the page: by tag in the order given, then by document order."""
    nth = F.array_position(F.array(*map(F.lit, tags)), F.col("tag"))
    order = Window.partitionBy("page_id").orderBy(nth, "node_id")
    return elements.where(F.col("tag").isin(*tags)).withColumn("place", F.row_number().over(order))


def tag_counts(html: str) -> Counter:
    return Counter(n.tag for n in Document(html).nodes)
