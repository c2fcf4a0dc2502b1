"""Source edits: from fixes of findings to patched pages and diffs."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import patch_filename

MECHANICAL = ("set-attribute", "remove-attribute", "remove-element")
STEPS = 64  # of a diff, of which one is kept
PLAN = (
    "filename string, patched string, diff string, applied array<string>, skipped array<string>,"
    " guidance array<struct<rule_id:string,css_path:string,strategy:string,text:string>>, automatic int, manual int"
)


def _pattern(name: str) -> re.Pattern:
    return re.compile(rf"""\s{re.escape(name)}(\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>])""", re.I)


def set_attribute(tag: str, name: str, value: str) -> str:
    """An opening tag with the attribute replaced, or put at its end."""
    spelled = value.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")
    new = f' {name}="{spelled}"'
    if _pattern(name).search(tag):
        return _pattern(name).sub(lambda _: new, tag, count=1)
    tail = "/>" if tag.endswith("/>") else ">"
    return tag[: -len(tail)].rstrip() + new + (" />" if tail == "/>" else ">")


def remove_attribute(tag: str, name: str) -> str:
    return _pattern(name).sub("", tag, count=1)


def edit_of(html: str, finding: dict) -> tuple[int, int, str] | None:
    """(start, end, replacement) of a finding's fix; None if no source edit makes it."""
    fix, start, end = finding["fix"], finding["start_off"], finding["end_off"]
    close = finding["elem_end_off"]
    if not fix or start is None or end is None:
        return None
    tag, kind, value = html[start:end], fix["strategy"], fix["value"]
    if kind == "set-attribute":
        if not value and fix["tier"] != "definite":
            return None
        return start, end, set_attribute(tag, fix["attribute"], value or "")
    if kind == "remove-attribute":
        return start, end, remove_attribute(tag, fix["attribute"])
    if kind == "insert-first-child" and value:
        indent = re.match(r"\n(\s*)", html[end : end + 200])
        return end, end, f"\n{indent[1] if indent else '  '}{value}"
    if close is None:
        return None
    if kind == "remove-element":
        return start, close, ""
    if kind == "rename-tag" and value:
        old = finding["tag"]
        whole = re.sub(rf"(?i)^<{old}\b", f"<{value}", html[start:close])
        return start, close, re.sub(rf"(?i)</{old}\s*>$", f"</{value}>", whole)
    return None


def apply_edits(html: str, edits: list[tuple]) -> tuple[str, list, list]:
    """Patched text, applied and skipped names; later places first, overlaps skipped."""
    applied, skipped, edge = [], [], len(html) + 1
    for start, end, new, name in sorted(edits, key=lambda e: -e[0]):
        if end > edge:
            skipped.append(name)
            continue
        html = html[:start] + new + html[end:]
        edge = start
        applied.append(name)
    return html, applied, skipped


def _nearer(reach: np.ndarray, d: int, x: np.ndarray, y: np.ndarray) -> None:
    """Makes ``reach`` of ``d`` differing lines from that of one less.

    By diagonal ``k``, at ``k + len(y) + 1``, it holds the first ``i`` from where ``x[i:]`` becomes
    ``y[i - k:]`` with at most ``d`` lines left out or put in; ``len(x) + 1`` where there is none.
    """
    n, m = len(x), len(y)
    k = np.arange(n - m - d, n - m + d + 1, 2)
    k = k[(k >= -m) & (k <= n)]
    at, first = k + m + 1, np.maximum(k, 0)
    if d:
        out, put = reach[at + 1], reach[at - 1]
        i = np.maximum(np.minimum(np.where(out <= n, out - 1, out), put), first)
    else:
        i = np.array([n])
    moving = np.flatnonzero(i > first)
    while len(moving):
        moving = moving[x[i[moving] - 1] == y[i[moving] - k[moving] - 1]]
        i[moving] -= 1
        moving = moving[i[moving] > first[moving]]
    reach[at] = i


def edit_script(before: list[str], after: list[str]) -> list[tuple[str, str]]:
    """(sign, line) from a longest common subsequence, at each place a line left out where that is as good as one put in.

    Time is the number of lines and the square of that of differing ones; of
    the steps, one in ``STEPS`` is kept and those between are made again.
    """
    numbers: dict[str, int] = {}
    x, y = (np.array([numbers.setdefault(line, len(numbers)) for line in z], dtype=np.int32) for z in (before, after))
    n, m = len(x), len(y)
    blank = np.full(n + m + 3, n + 1, dtype=np.int32)

    def span(d: int) -> slice:
        return slice(max(n - d + 1, 0), max(n + d + 2, 0))  # the diagonals that d lines reach

    reach, kept, left = blank.copy(), [], 0
    while True:
        if left % STEPS == 0:
            kept.append(reach[span(left)].copy())
        _nearer(reach, left, x, y)
        if reach[m + 1] == 0:
            break
        left += 1
    ops, i, j, rows, low = [], 0, 0, [], left + 1
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            ops.append((" ", before[i]))
            i, j = i + 1, j + 1
            continue
        left -= 1
        if left < low:
            low = left - left % STEPS
            reach, rows = blank.copy(), []
            reach[span(low)] = kept[low // STEPS]
            for d in range(low, left + 1):
                _nearer(reach, d, x, y)
                rows.append(reach[span(d + 2)].copy())  # a step aside may lead to two more
        at = i + 1 - j + m + 1
        if j == m or (i < n and rows[left - low][at - span(left + 2).start] <= i + 1):
            ops.append(("-", before[i]))
            i += 1
        else:
            ops.append(("+", after[j]))
            j += 1
    return ops


def unified_diff(before: str, after: str, name: str = "index.html", context: int = 3) -> str:
    """A unified diff from the longest common subsequence of lines."""
    if before == after:
        return ""
    a, b = before.split("\n"), after.split("\n")
    head = f"--- a/{name}\n+++ b/{name}\n"
    top = 0
    while top < min(len(a), len(b)) and a[top] == b[top]:
        top += 1
    low = 0
    while low < min(len(a), len(b)) - top and a[-1 - low] == b[-1 - low]:
        low += 1
    ops = [(" ", line) for line in a[:top]] + edit_script(a[top : len(a) - low], b[top : len(b) - low])
    ops += [(" ", line) for line in a[len(a) - low :]] if low else []
    keep = {k + d for k, (sign, _) in enumerate(ops) if sign != " " for d in range(-context, context + 1)}
    out, old, new, hunk = [head], 1, 1, []

    def flush() -> None:
        if hunk:
            n1, n2 = (sum(s != skip for s, _ in hunk) for skip in "+-")
            out.append(f"@@ -{old - n1},{n1} +{new - n2},{n2} @@\n" + "".join(f"{s}{line}\n" for s, line in hunk))
            hunk.clear()

    for k, (sign, line) in enumerate(ops):
        if k not in keep:
            flush()
        old, new = old + (sign != "+"), new + (sign != "-")
        if k in keep:
            hunk.append((sign, line))
    flush()
    return "".join(out)


def remediation_plan(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """One row a page: patched source, diff, what was applied, skipped and left to people.

    Fixes that are certain and of ``MECHANICAL`` kinds are applied; of these,
    ``skipped`` lists those that no edit could be built for and those that
    overlap another one. ``guidance`` says what people have to do: all
    findings that were not applied. Findings are first grouped by page, which
    bounds a task's rows by one page.
    """
    import pyarrow as pa

    fields = ["rule_id", "tag", "css_path", "start_off", "end_off", "elem_end_off", "fix", "message"]
    each = findings.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("findings"))
    name = patch_filename(F.col("url")) if "url" in pages.columns else F.lit("index.html")
    rows = pages.select("page_id", "html", name.alias("name")).join(each, "page_id", "left")
    step = pa.struct([(k, pa.string()) for k in ("rule_id", "css_path", "strategy", "text")])
    texts = pa.list_(pa.string())
    kinds = [pa.string(), pa.string(), pa.string(), texts, texts, pa.list_(step), pa.int32(), pa.int32()]
    names = "filename patched diff applied skipped guidance automatic manual".split()

    def plan(row: dict) -> tuple:
        html, found = row["html"] or "", row["findings"] or []
        edits, unbuilt = [], []
        for k, f in enumerate(found):
            fix = f["fix"]
            if fix and fix["tier"] == "definite" and fix["strategy"] in MECHANICAL:
                edit = edit_of(html, f)
                edits.append((*edit, k)) if edit else unbuilt.append(k)
        patched, applied, overlapping = apply_edits(html, edits)
        spelled = lambda ks: [f"{found[k]['rule_id']}|{found[k]['css_path']}" for k in ks]
        left = [f for k, f in enumerate(found) if k not in {*applied}]
        guidance = [
            {"rule_id": f["rule_id"], "css_path": f["css_path"], "strategy": (f["fix"] or {}).get("strategy") or "manual", "text": f["message"]} for f in left
        ]
        diff = unified_diff(html, patched, row["name"]) if applied else ""
        return row["name"], patched, diff, spelled(applied), spelled(unbuilt + overlapping), guidance, len(applied), len(left)

    def run(batches):
        for b in batches:
            out = [plan(row) for row in b.to_pylist()]
            columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["page_id", *names])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, {PLAN}")


def css_snippet(findings: DataFrame) -> DataFrame:
    """(page_id, css): color rules that the contrast findings suggest, in document order, each place and color once."""
    rows = findings.where("fix.strategy = 'css-color' and fix.value is not null")
    first = rows.groupBy("page_id", "css_path", F.col("fix.value").alias("value")).agg(F.min(F.struct("node_id", "fix.old", "fix.backdrop")).alias("f"))
    rule = F.concat("css_path", F.lit(" {\n  color: "), "value", F.lit("; /* was "), "f.old", F.lit(" on "), "f.backdrop", F.lit(" */\n}"))
    lines = first.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("f.node_id", rule.alias("rule")))).alias("r"))
    return lines.select("page_id", F.array_join(F.transform("r", lambda x: x["rule"]), "\n").alias("css"))
