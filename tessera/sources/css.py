"""Style sheets: rules of a text, selector matching, and the look of text elements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from tessera.functions.color import hex_of, number, over, parse_color

UNREADABLE = re.compile(r"[\[\]:+~]|\bnot\(")
HEADING_PX = {"h1": 32, "h2": 24, "h3": 18.72, "h4": 16, "h5": 13.28, "h6": 10.72}
KEYWORD_PX = {"xx-small": 9, "x-small": 10, "small": 13, "medium": 16, "large": 18, "x-large": 24, "xx-large": 32}
WHITE = (255, 255, 255, 1)


def declarations(text: str) -> dict[str, tuple[str, bool]]:
    """Property to (value, important); the last one of a name holds."""
    found = {}
    for chunk in text.split(";"):
        name, colon, value = chunk.partition(":")
        plain = re.sub(r"(?i)!important$", "", value.strip()).strip()
        if colon and name.strip() and value.strip():
            found[name.strip().lower()] = (plain, plain != value.strip())
    return found


@dataclass
class Rule:
    selector: str
    decls: dict[str, tuple[str, bool]]
    weight: tuple[int, int, int]
    order: int
    nested: bool
    steps: list[tuple[bool, str | None, list[str], list[str]]]  # from the right: (child of the next, tag, ids, classes)


def blocks(text: str) -> Iterator[tuple[str, str]]:
    """(prelude, body) of the top-level blocks; an open block ends with the text."""
    i = 0
    while (brace := text.find("{", i)) >= 0:
        depth, j = 1, brace + 1
        while j < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[j], 0)
            j += 1
        yield text[i:brace].strip(), text[brace + 1 : j - 1]
        i = j


def compiled(selector: str) -> list[tuple[bool, str | None, list[str], list[str]]] | None:
    steps, child = [], False
    for token in reversed(re.sub(r"\s*>\s*", " > ", selector).split()):
        if token == ">":
            child = True
            continue
        parts = re.findall(r"(?i)^[a-z][\w-]*|[#.][\w-]+|\*", token, re.ASCII)
        if not parts:
            return None
        names = [p.lower() for p in parts if p[0] not in "#.*"]
        # a left neighbour carries whether its right one must be its child
        steps.append((child, names[0] if names else None, [p[1:] for p in parts if p[0] == "#"], [p[1:] for p in parts if p[0] == "."]))
        child = False
    return steps


def parse_css(text: str | None) -> tuple[list[Rule], int]:
    """Rules in order, and how many unreadable selectors touch a color."""
    rules: list[Rule] = []
    unreadable = 0

    def take(source: str, nested: bool) -> None:
        nonlocal unreadable
        for prelude, body in blocks(source):
            if prelude.startswith("@"):
                name = re.split(r"[\s(]", prelude[1:])[0].lower()
                printed = re.search(r"\bprint\b", prelude) and not re.search(r"\bscreen\b", prelude)
                if name in ("supports", "layer", "scope") or (name == "media" and not printed):
                    take(body, True)
                continue
            decls = declarations(body)
            for selector in filter(None, (s.strip() for s in prelude.split(","))):
                if UNREADABLE.search(selector):
                    unreadable += not decls.keys().isdisjoint(("color", "background-color", "background"))
                    continue
                steps = compiled(selector)
                bare = re.sub(r"[#.][\w-]+", "", selector, flags=re.ASCII)
                weight = (
                    len(re.findall(r"#[\w-]+", selector, re.ASCII)),
                    len(re.findall(r"\.[\w-]+", selector, re.ASCII)),
                    len(re.findall(r"(?i)\b[a-z][\w-]*", bare, re.ASCII)),
                )
                rules.append(Rule(selector, decls, weight, len(rules) + 1, nested, steps or []))

    take(re.sub(r"/\*.*?\*/", "", text or "", flags=re.S), False)
    return rules, unreadable


def fits(node, step: tuple) -> bool:
    _, tag, ids, classes = step
    if tag and node.tag != tag:
        return False
    if any(node.attrs.get("id") != i for i in ids):
        return False
    return not classes or set(classes) <= set(node.attrs.get("class", "").split())


def matches(node, rule: Rule) -> bool:
    """Right to left; an ancestor step takes the nearest fitting element."""
    if not rule.steps or not fits(node, rule.steps[0]):
        return False
    for step in rule.steps[1:]:
        node = node.parent
        while node is not None and not step[0] and not fits(node, step):
            node = node.parent
        if node is None or not fits(node, step):
            return False
    return True


def declared(node, rules: list[Rule]) -> dict[str, str]:
    found: dict[str, tuple[str, bool]] = {}
    sources = [r.decls for r in sorted((r for r in rules if matches(node, r)), key=lambda r: (r.weight, r.order))]
    for decls in [*sources, declarations(node.attrs.get("style", ""))]:
        for name, (value, important) in decls.items():
            if important or name not in found or not found[name][1]:
                found[name] = (value, important)
    return {k: v for k, (v, _) in found.items()}


def size_of(value: str | None, inherited: float) -> float:
    raw = (value or "").strip().lower()
    if raw in KEYWORD_PX:
        return KEYWORD_PX[raw]
    n = number(raw)
    if n is None:
        return inherited
    for unit, scale in (("px", 1), ("pt", 96 / 72), ("rem", 16), ("em", inherited), ("%", inherited / 100)):
        if raw.endswith(unit):
            return n * scale
    return n


def backdrop_of(style: dict[str, str]) -> str | None:
    if style.get("background-color"):
        return style["background-color"]
    value = style.get("background", "")
    if re.search(r"(?i)url\(|gradient", value):
        return None
    return next((t for t in value.split() if parse_color(t)), None)


def look(style: dict[str, str], tag: str, inherited: tuple) -> tuple:
    """(color, px, bold, backdrop, backdrop known) of an element under one with ``inherited``."""
    color, px, bold, back, known = inherited
    if style.get("color"):
        parsed = parse_color(style["color"])
        if parsed:
            color = parsed
        elif not re.search(r"(?i)inherit|currentcolor", style["color"]):
            color = None
    px = size_of(style.get("font-size"), px)
    if tag in HEADING_PX and not style.get("font-size"):
        px = HEADING_PX[tag]
    weight = style.get("font-weight", "").strip().lower()
    if weight:
        n = number(weight)
        bold = weight in ("bold", "bolder") or (n is not None and n >= 700)
    elif tag in HEADING_PX or tag in ("strong", "b"):
        bold = True
    if layer := backdrop_of(style):
        parsed = parse_color(layer)
        if parsed is None:
            known = False
        elif parsed[3] > 0:
            back = over(parsed, back)
    return color, px, bold, back, known


def text_styles(doc, linked: str = "") -> tuple[dict[int, dict[str, str]], int]:
    """Looks of the elements with two or more characters of their own text, where they are known,
    and the number of color rules whose selectors cannot be read. Linked sheets come before inline ones.

    One fold down the tree: each element's style is declared once and
    inherits from its parent's, so the cost is elements times rules.
    """
    inline = "\n".join("".join(k for k in n.kids if isinstance(k, str)) for n in doc.nodes if n.tag == "style")
    rules, unreadable = parse_css("\n".join(filter(None, (linked, inline))))
    looks: dict[int, tuple] = {}
    found = {}
    for n in doc.nodes:
        above = looks.get(n.parent.number) if n.parent.tag != "#document" else None
        mine = looks[n.number] = look(declared(n, rules), n.tag, above or (None, 16.0, False, WHITE, True))
        color, px, bold, back, known = mine
        own = "".join(k for k in n.kids if isinstance(k, str))
        if color and known and not n.deep and len(re.sub(r"\s+", " ", own).strip()) >= 2:
            found[n.number] = {"fg": hex_of(over(color, back)), "bg": hex_of(back), "px": repr(px), "bold": str(bold).lower()}
    return found, unreadable
