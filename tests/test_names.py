"""Accessible names by joins, against stated names and the pass over one page."""

import random

import pytest

from tessera.functions.scratch import materialise
from tessera.operators import names
from tessera.sources.html import Document, html_elements, run_rows, text_of, text_runs

VECTORS = {
    '<label for="e">Email</label><input id="e">': {"input": ("Email", "label-for")},
    '<input aria-label=" Find ">': {"input": ("Find", "aria-label")},
    '<span id="a">Billing</span><b id="b">address</b><input aria-labelledby="a b none">': {"input": ("Billing address", "aria-labelledby")},
    "<button> Save <i>now</i></button>": {"button": ("Save now", "contents")},
    '<a href="/"><img src="x.png" alt="Home"></a>': {"a": ("Home", "contents")},
    '<button><span><svg aria-label="Close"></svg></span></button>': {"button": ("Close", "contents")},
    "<button><svg><title>Menu</title><path></path></svg></button>": {"button": ("Menu", "contents"), "svg": ("Menu", "svg-title")},
    '<button><i class="icon-x"></i></button>': {"button": ("", None)},
    "<button>a<b>b<b>c<b>d<b>e<b>f<b>g<b>h</b>i</b></b></b></b></b></b>z</button>": {"button": ("a b c d e f z", "contents")},
    '<label>Age <input title="t"> years</label>': {"input": ("Age years", "label-wrap")},
    "<fieldset><legend> <i hidden>x</i></legend></fieldset>": {"fieldset": ("", "legend")},
    '<input type="RESET"><p title=" tip ">': {"input": ("Reset", "implicit"), "p": ("tip", "title")},
}
TAGS = "div a button label span b svg title fieldset legend table caption h2 td script summary".split()
ALONE = ['<img alt=" pic {n}">', "<img>", '<input id="i{k}" type="{t}">', '<input value=" v{n} " type="{t}">', "<select id=i{k}></select>", '<input type=image alt="go{n}">', "<br>"]


def random_page(rng):
    def element(depth):
        if rng.random() < 0.25:
            return rng.choice(ALONE).format(n=rng.randrange(9), k=rng.randrange(3), t=rng.choice(["text", "submit", "button", "reset", "checkbox"]))
        tag, attrs = rng.choice(TAGS), ""
        for share, more in [(0.15, f' id="i{rng.randrange(5)}"'), (0.1, f' aria-labelledby="i{rng.randrange(5)}  i{rng.randrange(7)}"'), (0.08, f' aria-label="{rng.choice(["", "  ", "said"])}"'), (0.08, " hidden"), (0.08, ' title=" tip\t"')]:
            attrs += more if rng.random() < share else ""
        if tag == "label" and rng.random() < 0.5:
            attrs += f" for=i{rng.randrange(3)}"
        if tag == "a":
            attrs += ' href="/"'
        inner = "".join(rng.choice(["", " ", "x", f" w{rng.randrange(99)} "]) + element(depth + 1) for _ in range(rng.randrange(0, 4))) if depth < 9 else ""
        return f"<{tag}{attrs}>{rng.choice(['', 'text ', ' t'])}{inner}{rng.choice(['', ' end'])}</{tag}>"

    return "".join(element(0) for _ in range(8))


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(5)
    rows = [(k, html) for k, html in enumerate([*VECTORS, *(random_page(rng) for _ in range(60)), "", None, "plain"])]
    frame = spark.createDataFrame(rows, "page_id long, html string")
    elements, runs = materialise(html_elements(frame), "test-elements"), materialise(text_runs(frame), "test-runs")
    got = {(r.page_id, r.node_id): (r.acc_name, r.acc_source) for r in names.accessible_names(elements, runs).collect()}
    return rows, elements, runs, got


def test_names_equal_stated_ones(pages):
    rows, elements, _, got = pages
    tags = {(r.page_id, r.tag): r.node_id for r in elements.select("page_id", "tag", "node_id").collect()}
    for k, want in enumerate(VECTORS.values()):
        assert {t: got[k, tags[k, t]] for t in want} == want


def test_names_equal_the_pass_over_a_page(pages):
    _, elements, _, got = pages
    want = {(r.page_id, r.node_id): (r.acc_name, r.acc_source) for r in elements.select("page_id", "node_id", "acc_name", "acc_source").collect()}
    assert got == want
    ways = [w for _, w in want.values()]
    assert {w: ways.count(w) > 2 for w in set(ways)} == dict.fromkeys([*"aria-labelledby aria-label alt value implicit label-for label-wrap svg-title legend caption contents title".split(), None], True)


def test_texts_and_runs_of_elements(pages):
    rows, elements, runs, _ = pages
    for hidden in (False, True):
        got = {(r.page_id, r.node_id): r.text for r in names.texts_of(elements, runs, elements.select("page_id", "node_id", "last_id"), hidden).collect()}
        assert got == {(k, n.number): text_of(n, hidden) for k, html in rows if html for n in Document(html).nodes}
    for _, html in rows:
        if html:  # document order of runs is that of a walk
            flat, stack = [], [Document(html).root]
            while stack:
                n = stack.pop()
                if isinstance(n, str):
                    flat.append(n)
                else:
                    stack.extend(reversed(n.kids))
            assert [t for *_, t in sorted(run_rows(html), key=lambda r: (r[1], -r[0], r[2]))] == flat


def test_names_of_no_pages(spark):
    none = spark.createDataFrame([], "page_id string, html string")
    assert names.accessible_names(html_elements(none), text_runs(none)).count() == 0
