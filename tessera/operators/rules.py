"""The detection rules: filters, groupings, windows and anti-joins over elements."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions.color import contrast_ratio, painted, required_ratio, suggested_color
from tessera.functions.scratch import materialise
from tessera.functions.text import icon_name, rounded, signature

# ``old`` and ``backdrop`` are the colors that a new one replaces and stands on
FIX = "struct<strategy:string,attribute:string,value:string,tier:string,old:string,backdrop:string>"
FOUND = "struct<rule_id:string,tier:string,key:string,message:string,fix:{}>".format(FIX)


@dataclass
class Rule:
    """A rule and, for those that look at one element only, its condition.

    ``where`` is SQL over a row of elements; ``tier`` may be SQL too. ``fix``
    is (strategy, attribute, value SQL, tier SQL).
    """

    id: str
    wcag: str
    level: str
    impact: str
    tier: str
    message: str
    where: str | None = None
    key: str = "cast(null as string)"
    fix: tuple[str, str, str, str] = ("manual", "", "cast(null as string)", "'review'")
    each: str | None = None  # SQL array: one finding for each of its strings
    times: str | None = None  # SQL number of findings, where an element may count more than once
    section508: list[str] = field(default_factory=list)


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _array(words: list[str]) -> str:
    return "array" + _in(words)


BUTTON_INPUT = "(tag = 'input' and lower(coalesce(attrs['type'], '')) in ('button', 'submit', 'reset', 'image'))"
LIKE_BUTTON = f"(tag = 'button' or {BUTTON_INPUT} or lower(attrs['role']) = 'button')"
LINK = "tag = 'a' and attrs['href'] is not null"
SEEN = "not hidden_deep"
UNNAMED = "acc_name = ''"
LABELLED = "(coalesce(attrs['aria-label'], '') <> '' or coalesce(attrs['aria-labelledby'], '') <> '')"
DECORATIVE = "coalesce(lower(attrs['role']), '') in ('presentation', 'none')"
FIELD = "tag in ('input', 'select', 'textarea') and lower(coalesce(attrs['type'], 'text')) not in ('hidden', 'submit', 'button', 'reset', 'image')"
REVIEW, DEFINITE, ADVISORY = "'review'", "'definite'", "'advisory'"


def set_attribute(name: str, value: str, tier: str = REVIEW) -> tuple[str, str, str, str]:
    return "set-attribute", name, value, tier


NO_VALUE = "cast(null as string)"
FRAME_TITLE = "case " + " ".join(f"when coalesce(attrs['src'], '') rlike '(?i){p.replace(chr(92), chr(92) * 2)}' then '{t}'" for p, t in fixed.FRAME_TITLES) + " end"
REQUIRED = "case lower(trim(attrs['role'])) " + " ".join(f"when '{r}' then '{a}'" for r, a in fixed.REQUIRED_ARIA.items()) + " end"
SKIP = "rlike '(?i)skip|jump'"

RULES = [
    Rule("img-alt", "1.1.1", "A", "critical", DEFINITE, "Image has no alternative text",
         f"tag = 'img' and {SEEN} and not {DECORATIVE} and attrs['alt'] is null and not {LABELLED}",
         fix=set_attribute("alt", "''"), section508=["502.3.1"]),
    Rule("img-alt-placeholder", "1.1.1", "A", "serious",
         f"case when trim(attrs['alt']) rlike '{fixed.PLACEHOLDER_ALT.replace(chr(92), chr(92) * 2)}' or trim(attrs['alt']) rlike '(?i)[.](png|jpe?g|gif|svg|webp|avif)$' then 'definite' else 'review' end",
         "Alternative text does not describe the image",
         f"tag = 'img' and {SEEN} and trim(coalesce(attrs['alt'], '')) <> '' and (trim(attrs['alt']) rlike '{fixed.PLACEHOLDER_ALT.replace(chr(92), chr(92) * 2)}'"
         " or trim(attrs['alt']) rlike '(?i)[.](png|jpe?g|gif|svg|webp|avif)$' or trim(attrs['alt']) rlike '(?i)^(image|picture|photo|graphic) of ')",
         fix=set_attribute("alt", "''")),
    Rule("svg-name", "1.1.1", "A", "serious", REVIEW, "Graphic has no name",
         f"tag = 'svg' and {SEEN} and not {DECORATIVE} and {UNNAMED} and (lower(attrs['role']) = 'img' or focusable or exists(ancestors, a -> a.tag in ('a', 'button')))"
         " and not exists(ancestors, a -> a.tag in ('a', 'button') and a.named)",
         fix=set_attribute("aria-label", "''")),
    Rule("button-name", "4.1.2", "A", "critical", DEFINITE, "Button has no name",
         f"{LIKE_BUTTON} and {SEEN} and {UNNAMED}", fix=set_attribute("aria-label", "coalesce(icon, '')"), section508=["502.3.1"],
         # a button by its type and by its role is two findings
         times=f"cast({BUTTON_INPUT} as int) + cast(tag = 'button' or coalesce(lower(attrs['role']) = 'button', false) as int)"),
    Rule("link-name", "2.4.4,4.1.2", "A", "critical", DEFINITE, "Link has no name",
         f"{LINK} and {SEEN} and {UNNAMED}", fix=set_attribute("aria-label", "''"), section508=["502.3.1"]),
    Rule("link-generic-text", "2.4.4", "A", "moderate", REVIEW, "Link text does not say where it leads",
         f"{LINK} and {SEEN} and not {LABELLED} and trim(regexp_replace(lower(acc_name), '[^a-z\\\\s]', '')) in {_in(fixed.GENERIC_LINKS)}",
         fix=set_attribute("aria-label", "''")),
    Rule("input-label", "1.3.1,3.3.2,4.1.2", "A", "critical", DEFINITE, "Form field has no label",
         f"{FIELD} and {SEEN} and {UNNAMED}",
         fix=set_attribute("aria-label", "trim(coalesce(attrs['placeholder'], ''))", "case when trim(coalesce(attrs['placeholder'], '')) <> '' then 'definite' else 'review' end"),
         section508=["502.3.1"]),
    Rule("frame-title", "4.1.2", "A", "serious", DEFINITE, "Frame has no title",
         f"tag in ('iframe', 'frame') and {SEEN} and trim(coalesce(attrs['title'], '')) = '' and not {LABELLED}",
         fix=set_attribute("title", f"coalesce({FRAME_TITLE}, '')", f"case when {FRAME_TITLE} is not null then 'definite' else 'review' end")),
    Rule("nested-interactive", "4.1.2", "A", "serious", DEFINITE, "Control inside another control",
         f"(tag in ('button', 'select', 'textarea', 'input') or {LINK}) and {SEEN} and coalesce(lower(attrs['type']), '') <> 'hidden'"
         " and exists(ancestors, a -> a.tag in ('button', 'select', 'textarea') or (a.tag = 'a' and a.href))"),
    Rule("empty-heading", "1.3.1", "A", "moderate", DEFINITE, "Heading is empty", f"tag rlike '^h[1-6]$' and {SEEN} and {UNNAMED}"),
    Rule("list-structure", "1.3.1", "A", "minor", DEFINITE, "List holds something other than items",
         f"tag in ('ul', 'ol') and {SEEN} and (stray_text or exists(kids, k -> k.tag not in ('li', 'script', 'template')))"),
    Rule("table-headers", "1.3.1", "A", "serious", REVIEW, "Data table without header cells",
         f"tag = 'table' and {SEEN} and not {DECORATIVE} and cast(facts['rows'] as int) >= 2 and facts['head_rows'] = '0'"),
    Rule("tabindex-positive", "2.4.3", "A", "serious", DEFINITE, "Positive tabindex changes the focus order",
         "try_cast(regexp_extract(attrs['tabindex'], '^\\\\s*([+-]?[0-9]+)', 1) as int) > 0", fix=set_attribute("tabindex", "'0'", DEFINITE)),
    Rule("aria-hidden-focusable", "1.3.1,4.1.2", "A", "serious", DEFINITE, "Hidden content can take the focus",
         "attrs['aria-hidden'] = 'true' and holds_focusable"),
    Rule("aria-valid-role", "4.1.2", "A", "serious", DEFINITE, "Unknown role",
         f"size(array_except(filter(split(lower(trim(attrs['role'])), '\\\\s+'), r -> r <> ''), {_array(fixed.VALID_ROLES)})) > 0"),
    Rule("aria-valid-attr", "4.1.2", "A", "moderate", DEFINITE, "Unknown aria attribute",
         f"size(array_except(filter(map_keys(attrs), k -> startswith(k, 'aria-')), {_array(fixed.VALID_ARIA)})) > 0"),
    Rule("aria-required-attr", "4.1.2", "A", "serious", DEFINITE, "Role needs an attribute that is missing",
         f"attrs['role'] is not null and {REQUIRED} is not null and not array_contains(map_keys(attrs), {REQUIRED})"),
    Rule("meta-viewport-zoom", "1.4.4", "AA", "serious", DEFINITE, "Viewport settings block zooming",
         "tag = 'meta' and lower(attrs['name']) = 'viewport' and (attrs['content'] rlike '(?i)user-scalable\\\\s*=\\\\s*(no|0)'"
         " or try_cast(regexp_extract(attrs['content'], '(?i)maximum-scale\\\\s*=\\\\s*([0-9]*[.]?[0-9]+)', 1) as double) < 2)",
         fix=set_attribute("content", "coalesce(nullif(array_join(filter(transform(split(attrs['content'], ','), p -> trim(p)), p -> not p rlike '(?i)^(user-scalable|maximum-scale)'), ', '), ''),"
                           " 'width=device-width, initial-scale=1')", DEFINITE)),
    Rule("meta-refresh", "2.2.1,2.2.4", "A", "serious", DEFINITE, "Page reloads or moves on by itself",
         "tag = 'meta' and lower(attrs['http-equiv']) = 'refresh' and try_cast(regexp_extract(attrs['content'], '^\\\\s*([0-9.]+)', 1) as double) <= 72000",
         fix=("remove-element", "", NO_VALUE, REVIEW)),
    Rule("autoplay-media", "1.4.2", "A", "serious", DEFINITE, "Sound starts by itself",
         "tag in ('audio', 'video') and attrs['autoplay'] is not null and attrs['muted'] is null", fix=set_attribute("muted", "''")),
    Rule("video-captions", "1.2.2", "A", "serious", REVIEW, "Video without captions",
         f"tag = 'video' and {SEEN} and not exists(kids, k -> k.tag = 'track' and k.kind in ('captions', 'subtitles'))"),
    Rule("blink-marquee", "2.2.2", "A", "serious", DEFINITE, "Moving text that cannot be stopped", "tag in ('blink', 'marquee')"),
    Rule("click-handler-no-keyboard", "2.1.1", "A", "critical", DEFINITE, "Clickable element is out of the keyboard's reach",
         f"attrs['onclick'] is not null and {SEEN} and tag not in {_in(fixed.NATIVE_INTERACTIVE)} and not focusable"
         f" and not (coalesce(role, '') in {_in(fixed.INTERACTIVE_ROLES)} and attrs['tabindex'] is not null)", section508=["502.3.1"]),
    Rule("interactive-role-not-focusable", "2.1.1,4.1.2", "A", "critical", DEFINITE, "Control by role cannot take the focus",
         f"attrs['role'] is not null and role in {_in(fixed.INTERACTIVE_ROLES)} and {SEEN} and tag not in {_in(fixed.NATIVE_INTERACTIVE)}"
         " and not focusable and coalesce(attrs['aria-disabled'], '') <> 'true'", fix=set_attribute("tabindex", "'0'")),
    Rule("aria-boolean-invalid", "4.1.2", "A", "serious", DEFINITE, "Yes/no attribute with another value", "true", key="one",
         each=f"filter({_array(fixed.BOOLEAN_ARIA)}, n -> attrs[n] is not null and not (lower(trim(attrs[n])) in ('true', 'false')"
         " or (n in ('aria-checked', 'aria-pressed') and lower(trim(attrs[n])) in ('mixed', 'undefined'))))"),
    Rule("aria-live-invalid", "4.1.3", "AA", "moderate", DEFINITE, "Unknown live region setting",
         "attrs['aria-live'] is not null and lower(trim(attrs['aria-live'])) not in ('off', 'polite', 'assertive')", fix=set_attribute("aria-live", "'polite'")),
    Rule("aria-presentation-on-interactive", "4.1.2", "A", "serious", DEFINITE, "Control is marked as decoration", f"{DECORATIVE} and focusable"),
    Rule("aria-redundant-role", "4.1.2", "A", "minor", ADVISORY, "Role repeats what the element is",
         "trim(coalesce(attrs['role'], '')) <> '' and lower(trim(attrs['role'])) = role_implicit", fix=("remove-attribute", "role", NO_VALUE, REVIEW)),
    Rule("autocomplete-missing", "1.3.5", "AA", "moderate", ADVISORY, "Personal field without autocomplete",
         f"tag = 'input' and {SEEN} and lower(coalesce(nullif(attrs['type'], ''), 'text')) not in {_in(fixed.IMPERSONAL_TYPES)} and attrs['autocomplete'] is null"
         f" and (coalesce(lower(attrs['type']), '') in ('email', 'tel') or trim(concat_ws(' ', attrs['name'], attrs['id'])) rlike '{fixed.PERSONAL_FIELD}')"),
    Rule("autocomplete-invalid", "1.3.5", "AA", "moderate", DEFINITE, "Unknown autocomplete token",
         "trim(coalesce(attrs['autocomplete'], '')) <> '' and size(array_except(filter(split(lower(trim(attrs['autocomplete'])), '\\\\s+'), t -> not startswith(t, 'section-')),"
         f" {_array(fixed.AUTOCOMPLETE + fixed.AUTOCOMPLETE_MODIFIERS)})) > 0"),
    Rule("label-empty", "1.3.1,3.3.2", "A", "serious", DEFINITE, "Label has no text",
         f"tag = 'label' and {SEEN} and coalesce(text_all, '') = '' and coalesce(attrs['aria-label'], '') = ''"),
    Rule("button-type-missing", "3.2.2", "A", "minor", ADVISORY, "Button in a form without a type",
         f"tag = 'button' and {SEEN} and attrs['type'] is null and exists(ancestors, a -> a.tag = 'form')", fix=set_attribute("type", "'button'")),
    Rule("link-empty-href", "2.1.1,4.1.2", "A", "moderate", ADVISORY, "Link leads nowhere",
         f"tag = 'a' and {SEEN} and (trim(attrs['href']) = '#' or lower(trim(attrs['href'])) like 'javascript:%')"),
    Rule("link-url-as-text", "2.4.4", "A", "minor", ADVISORY, "Link text is a bare address",
         f"{LINK} and {SEEN} and length(text) >= 20 and text rlike '(?i)^https?://\\\\S+$'"),
    Rule("new-window-no-warning", "3.2.2", "A", "minor", ADVISORY, "Link opens a window unannounced",
         f"tag = 'a' and {SEEN} and lower(attrs['target']) = '_blank' and not acc_name rlike '(?i)new (window|tab)|opens in' and not coalesce(attrs['title'], '') rlike '(?i)new (window|tab)'"),
    Rule("landmark-nesting", "1.3.1", "A", "minor", ADVISORY, "Page header or footer inside a section",
         f"tag in ('header', 'footer') and {SEEN} and exists(ancestors, a -> a.tag in ('main', 'article', 'section', 'aside', 'nav'))"),
    Rule("definition-list-structure", "1.3.1", "A", "minor", DEFINITE, "Definition list holds something else",
         f"tag = 'dl' and {SEEN} and (stray_text or exists(kids, k -> k.tag not in ('dt', 'dd', 'div', 'script', 'template')))"),
    Rule("th-scope-missing", "1.3.1", "A", "moderate", REVIEW, "Header cells do not say what they head",
         "facts['lacks_scope'] is not null", times="cast(facts['lacks_scope'] as int)"),
    Rule("id-invalid", "4.1.1", "A", "minor", DEFINITE, "Id contains blanks", "attrs['id'] rlike '\\\\s'"),
    Rule("audio-no-transcript", "1.2.1", "A", "serious", REVIEW, "Audio without a transcript nearby",
         f"tag = 'audio' and {SEEN} and not coalesce(facts['transcript'], '') = 'true'"),
    Rule("video-no-audio-description", "1.2.5", "AA", "moderate", REVIEW, "Video without a description track",
         f"tag = 'video' and {SEEN} and not exists(kids, k -> k.tag = 'track' and k.kind = 'descriptions')"),
    Rule("object-no-fallback", "1.1.1", "A", "moderate", REVIEW, "Embedded object without an alternative",
         f"tag in ('object', 'embed') and {SEEN} and {UNNAMED} and not (tag = 'object' and coalesce(text, '') <> '')"),
    Rule("title-attribute-as-label", "4.1.2", "A", "minor", ADVISORY, "Only a tooltip names the control",
         f"tag in ('input', 'select', 'textarea', 'button', 'a') and {SEEN} and acc_source = 'title'"),
    Rule("iframe-negative-tabindex", "2.1.1", "A", "moderate", ADVISORY, "Frame is taken out of the focus order",
         f"tag = 'iframe' and {SEEN} and attrs['tabindex'] = '-1'", fix=("remove-attribute", "tabindex", NO_VALUE, REVIEW)),
    Rule("duplicate-alt-adjacent", "1.1.1", "A", "minor", ADVISORY, "Image repeats the text of its link",
         "facts['echoes'] is not null", times="cast(facts['echoes'] as int)", fix=set_attribute("alt", "''")),
    # rules over several rows
    Rule("label-orphan", "1.3.1", "A", "serious", DEFINITE, "Label points to no field"),
    Rule("html-has-lang", "3.1.1", "A", "serious", DEFINITE, "Page language is not given", fix=set_attribute("lang", "'en'", DEFINITE), section508=["501"]),
    Rule("html-lang-valid", "3.1.1", "A", "moderate", DEFINITE, "Page language is not a language tag", fix=set_attribute("lang", "'en'")),
    Rule("document-title", "2.4.2", "A", "serious", DEFINITE, "Page has no title"),
    Rule("page-has-h1", "1.3.1,2.4.6", "A", "moderate", REVIEW, "Page has no main heading"),
    Rule("heading-order", "1.3.1", "A", "moderate", REVIEW, "Heading level is skipped", fix=("rename-tag", "", NO_VALUE, REVIEW)),
    Rule("duplicate-id", "4.1.1", "A", "moderate", DEFINITE, "Id is used again"),
    Rule("landmark-main", "1.3.1,2.4.1", "A", "moderate", REVIEW, "Page has no main region"),
    Rule("landmark-unique", "1.3.1", "A", "minor", REVIEW, "Regions of one kind need names", fix=set_attribute("aria-label", "''")),
    Rule("skip-link", "2.4.1", "A", "serious", REVIEW, "No way to skip the navigation", 
         fix=("insert-first-child", "", NO_VALUE, REVIEW)),
    Rule("color-contrast", "1.4.3", "AA", "serious", DEFINITE, "Text stands out too little", fix=("css-color", "color", NO_VALUE, REVIEW), section508=["502.3"]),
    Rule("focus-not-obscured", "2.4.7", "AA", "serious", REVIEW, "Focus outline is removed"),
    Rule("target-size-minimum", "2.5.8", "AA", "moderate", DEFINITE, "Target is smaller than 24 pixels"),
    Rule("horizontal-scroll", "1.4.10", "AA", "serious", DEFINITE, "Page is wider than the screen"),
    Rule("skip-link-target-missing", "2.4.1", "A", "serious", DEFINITE, "Skip link leads nowhere"),
    Rule("accesskey-duplicate", "2.1.1", "A", "minor", DEFINITE, "Access key is used again"),
    Rule("aria-describedby-orphan", "1.3.1,4.1.2", "A", "serious", DEFINITE, "Referenced id does not exist"),
    Rule("fieldset-legend-missing", "1.3.1,3.3.2", "A", "serious", REVIEW, "Group of choices has no name"),
    Rule("link-same-name-different-target", "2.4.4", "A", "moderate", REVIEW, "One link text, several targets"),
    Rule("main-multiple", "1.3.1", "A", "moderate", DEFINITE, "More than one main region"),
    Rule("h1-multiple", "1.3.1", "A", "minor", ADVISORY, "More than one main heading", fix=("rename-tag", "", "'h2'", REVIEW)),
    Rule("viewport-missing", "1.4.10", "AA", "moderate", REVIEW, "No viewport settings",
         fix=("insert-first-child", "", "'<meta name=\"viewport\" content=\"width=device-width, initial-scale=1\">'", REVIEW)),
    Rule("text-justified", "1.4.8", "AAA", "minor", ADVISORY, "Justified text"),
    # needs a hint that no analysis gives, so it finds nothing
    Rule("noscript-missing", "4.1.2", "A", "minor", ADVISORY, "No content without scripts"),
]
BY_ID = {r.id: r for r in RULES}
ADDED: dict = {}  # rules with functions of their own
REFERENCES = "aria-labelledby aria-describedby aria-controls aria-owns aria-details aria-errormessage".split()


def register(rule: Rule, run=None) -> None:
    """Adds a rule to those that ``find_all`` applies.

    A rule with ``where`` or ``each`` joins the single pass over elements;
    ``run(elements)`` of another gives its findings, in the form of ``findings_of``.
    """
    if rule.id in BY_ID:
        raise ValueError(f"rule {rule.id} is there already")
    if run is None and not (rule.where or rule.each):
        raise ValueError(f"rule {rule.id} has neither a condition nor a function")
    RULES.append(rule)
    BY_ID[rule.id] = rule
    if run is not None:
        ADDED[rule.id] = run


def unregister(rule_id: str) -> None:
    RULES.remove(BY_ID.pop(rule_id))
    ADDED.pop(rule_id, None)


def catalog(spark) -> DataFrame:
    """The rules as a small table."""
    rows = [(n, r.id, r.wcag.split(","), r.level, r.impact, r.message, r.section508) for n, r in enumerate(RULES)]
    return spark.createDataFrame(
        rows, "rule_order int, rule_id string, wcag array<string>, level string, impact string, title string, section508 array<string>"
    )


def _fix_sql(rule: Rule) -> str:
    strategy, name, value, tier = rule.fix
    return f"named_struct('strategy', '{strategy}', 'attribute', nullif('{name}', ''), 'value', cast({value} as string), 'tier', {tier}, 'old', {NO_VALUE}, 'backdrop', {NO_VALUE})"


def _one(rule: Rule, key: str) -> str:
    message = rule.message.replace("'", "\\'")
    return f"named_struct('rule_id', '{rule.id}', 'tier', {rule.tier}, 'key', {key}, 'message', '{message}', 'fix', {_fix_sql(rule)})"


def row_findings(elements: DataFrame) -> DataFrame:
    """All rules that look at one element, in a single pass: no shuffle, one explode."""
    singles, lists = [], []
    for r in RULES:
        if r.times:
            lists.append(f"if(coalesce({r.where}, false), array_repeat({_one(r, r.key)}, {r.times}), cast(array() as array<{FOUND}>))")
        elif r.each:
            lists.append(f"transform({r.each}, one -> {_one(r, 'one')})")
        elif r.where:
            singles.append(f"case when {r.where} then {_one(r, r.key)} end")
    found = f"concat(filter(array({', '.join(singles)}), x -> x is not null), {', '.join(lists)})"
    rows = elements.withColumn("icon", icon_name(F.col("classes"), fixed.ICON_NAMES)).withColumn("found", F.explode_outer(F.expr(found)))
    return rows.where("found is not null").select(*PLACE, "found.*")


PLACE = ["page_id", "node_id", "tag", "css_path", "snippet", "line", "col", "start_off", "end_off", "elem_end_off"]


def findings_of(rows: DataFrame, rule: str, key: Column | None = None, tier: str | None = None, fix: Column | None = None) -> DataFrame:
    """Rows of elements as findings of one rule."""
    r = BY_ID[rule]
    key = F.lit(None).cast("string") if key is None else key.cast("string")
    fix = F.expr(_fix_sql(r)) if fix is None else fix
    return rows.select(
        *PLACE, F.lit(rule).alias("rule_id"), F.expr(tier or r.tier).alias("tier"), key.alias("key"), F.lit(r.message).alias("message"), fix.alias("fix")
    )


def page_findings(elements: DataFrame) -> DataFrame:
    """Rules on the presence of something in a page: one grouping for all of them."""
    c = F.col
    seen, attrs = ~c("hidden_deep"), c("attrs")

    def any_of(cond: Column) -> Column:
        return F.max(F.coalesce(cond, F.lit(False)))

    place = F.struct(*[x for x in PLACE if x != "page_id"])
    first = lambda cond: F.min(F.when(cond, F.struct("node_id", place.alias("p"))))
    link = (c("tag") == "a") & attrs["href"].isNotNull()
    pages = elements.groupBy("page_id").agg(
        first(c("tag") == "html").alias("html"),
        first(c("tag") == "head").alias("head"),
        first(c("tag") == "title").alias("title_at"),
        first(c("tag") == "body").alias("body"),
        F.min_by(F.when(c("tag") == "html", F.coalesce(attrs["lang"], F.lit(""))), F.when(c("tag") == "html", c("node_id"))).alias("lang"),
        F.min_by(F.when(c("tag") == "title", c("text_all")), F.when(c("tag") == "title", c("node_id"))).alias("title"),
        any_of(((c("tag") == "h1") & seen) | ((attrs["role"] == "heading") & (attrs["aria-level"] == "1"))).alias("has_h1"),
        any_of((c("tag") == "main") | (F.lower(attrs["role"]) == "main")).alias("has_main"),
        # the first main region's id, empty where it has none
        F.min_by(F.coalesce(attrs["id"], F.lit("")), F.when((c("tag") == "main") | (attrs["role"] == "main"), c("node_id"))).alias("main_id"),
        any_of((c("tag") == "meta") & (F.lower(attrs["name"]) == "viewport")).alias("has_viewport"),
        any_of(c("role") == "navigation").alias("has_nav"),
        F.count_if(link).alias("links"),
        # the first five links decide; a page's links are bounded by the page
        F.slice(F.sort_array(F.collect_list(F.when(link, F.struct("node_id", attrs["href"].alias("href"), F.coalesce("text_all", F.lit("")).alias("text"))))), 1, 5).alias("first_links"),
        # linked sheets, which the root holds, come before inline ones
        F.concat_ws(
            "\n",
            F.max(F.when(c("tag") == "html", F.nullif(c("facts")["linked"], F.lit("")))),
            F.transform(F.sort_array(F.collect_list(F.when(c("tag") == "style", F.struct("node_id", "text_all")))), lambda x: x["text_all"]),
        ).alias("css"),
    )
    skips = F.exists("first_links", lambda x: x["href"].startswith("#") & x["text"].rlike("(?i)skip|jump"))
    lang = F.trim(c("lang"))
    cases = {
        "html-has-lang": (c("html").isNotNull() & (lang == ""), "html"),
        "html-lang-valid": ((lang != "") & ~lang.rlike(r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$"), "html"),
        "document-title": (F.coalesce("title", F.lit("")) == "", "titled"),
        "page-has-h1": (~c("has_h1"), "body"),
        "landmark-main": (~c("has_main"), "body"),
        "viewport-missing": (c("head").isNotNull() & ~c("has_viewport"), "head"),
        "skip-link": ((c("has_nav") | (c("links") >= 10)) & ~skips, "body"),
        "text-justified": (c("css").rlike(r"(?i)text-align\s*:\s*justify"), "body"),
    }
    link_to_main = F.concat(F.lit('<a class="skip-link" href="#'), F.coalesce(F.nullif("main_id", F.lit("")), F.lit("main-content")), F.lit('">Skip to main content</a>'))
    fixes = {r: F.expr(_fix_sql(BY_ID[r])) for r in cases}
    fixes["skip-link"] = fixes["skip-link"].withField("value", link_to_main)
    pages = pages.withColumn("titled", F.coalesce("title_at", "head"))
    found = F.array(
        *(
            F.when(
                cond,
                F.struct(
                    c(where)["p"].alias("p"), F.lit(rule).alias("rule_id"), F.expr(BY_ID[rule].tier).alias("tier"), F.lit(None).cast("string").alias("key"),
                    F.lit(BY_ID[rule].message).alias("message"), fixes[rule].alias("fix"),
                ),
            )
            for rule, (cond, where) in cases.items()
        )
    )
    rows = pages.select("page_id", "body", "css", F.explode(found).alias("f")).where("f is not null and f.p is not null")
    flat = rows.select("page_id", *[F.col(f"f.p.{x}").alias(x) for x in PLACE if x != "page_id"], "f.rule_id", "f.tier", "f.key", "f.message", "f.fix")
    return flat.unionByName(_focus_findings(pages))


def _focus_findings(pages: DataFrame) -> DataFrame:
    """Style rules that take the focus outline away: each selector once, the first three of a page's style sheets."""
    blocks = F.regexp_extract_all("css", F.lit(fixed.FOCUS_BLOCK), 1)

    def bare(block: Column) -> Column:
        inside = F.regexp_extract(block, r"\{([^}]*)\}", 1)
        return inside.rlike(fixed.OUTLINE_OFF) & ~F.regexp_replace(inside, fixed.OUTLINE, "").rlike(fixed.FOCUS_SIGN)

    selectors = F.transform(
        F.filter(blocks, bare), lambda x: F.left(F.trim(F.regexp_replace(F.split_part(x, F.lit("{"), F.lit(1)), r"\s+", " ")), F.lit(120))
    )
    rows = pages.where("body is not null").select("page_id", "body", F.explode_outer(F.slice(F.array_distinct(selectors), 1, 3)).alias("selector"))
    rows = rows.where("selector is not null").select("page_id", *[F.col(f"body.p.{x}").alias(x) for x in PLACE if x != "page_id"], "selector")
    return findings_of(rows, "focus-not-obscured", F.col("selector"))


def measured_looks(elements: DataFrame, measurements: DataFrame) -> DataFrame:
    """The elements with text of their own, in colors and sizes that a browser painted, where it did.

    ``measurements`` may have (color, background, font_size, font_weight,
    opacity): ``background`` is the nearest opaque one (``color.nearest_backdrop``);
    a translucent element's color is laid over it. What was not measured keeps
    its inferred look.
    """
    looks = [c for c in ("color", "background", "font_size", "font_weight", "opacity") if c in measurements.columns]
    if not {"color", "background"} <= {*looks}:
        return elements
    absent = [F.lit(None).alias(c) for c in ("font_size", "font_weight", "opacity") if c not in looks]
    m = measurements.select("page_id", "css_path", *looks, *absent).dropDuplicates(["page_id", "css_path"])
    # only what shows text of its own gets colors, and only rules on these read the result
    rows = elements.where(F.col("facts")["fg"].isNotNull() | (F.length(F.trim("own_text")) >= 2))
    rows = rows.select(*PLACE, "hidden_deep", "own_text", "facts")
    columns = rows.columns
    rows = rows.join(m, ["page_id", "css_path"], "left")
    fg, bg = painted("color", "background", F.coalesce(F.col("opacity").cast("double"), F.lit(1.0)))
    weight = F.col("font_weight").cast("string")
    bold = (weight == "bold") | F.coalesce(weight.try_cast("int") >= 700, F.lit(False))
    enough = F.length(F.trim("own_text")) >= 2
    look = F.create_map(
        F.lit("fg"), fg, F.lit("bg"), bg, F.lit("px"), F.coalesce(F.col("font_size").cast("double"), F.lit(16.0)).cast("string"),
        F.lit("bold"), F.coalesce(bold, F.lit(False)).cast("string"),
    )
    others = F.map_filter("facts", lambda k, v: ~k.isin("fg", "bg", "px", "bold"))
    facts = F.when(fg.isNotNull() & bg.isNotNull() & enough, F.map_concat(others, look)).otherwise(F.col("facts"))
    return rows.withColumn("facts", facts).select(*columns)


def jumps(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows whose ``rank`` is more than one over that of the row before, which ``before`` holds."""
    rows = rows.withColumn("before", F.lag("rank").over(Window.partitionBy(*by).orderBy(*order)))
    return rows.where(F.col("rank") > F.col("before") + 1)


def repeats(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """All but the first row of each group; ``nth`` counts from 2."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("nth > 1")


def several_targets(links: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, node_id) of names that stand for two targets or more, at the first link.

    Few links are alike, so they are shuffled before they are put together, into a fixed
    number of partitions: a task before the shuffle would hold most of its input in memory.
    So are the targets, or one task would hold two tables of them.
    """
    spark = links.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    once = links.repartition(parts, *by, "href").groupBy(*by, "href").agg(F.min("node_id").alias("node_id"))
    return once.repartition(parts, *by).groupBy(*by).agg(F.count("href").alias("n"), F.min("node_id").alias("node_id")).where("n >= 2")


def window_findings(elements: DataFrame, painted_elements: DataFrame | None = None) -> DataFrame:
    """Rules on the order of elements within a page: windows by page, in document order.

    Colors are those of ``painted_elements``, where there are such; no other rule reads them.
    """
    c, attrs = F.col, F.col("attrs")
    heads = elements.where(c("tag").rlike("^h[1-6]$") & ~c("hidden_deep")).withColumn("rank", F.substring("tag", 2, 1).cast("int"))
    skipped = jumps(heads, ["page_id"], ["node_id"])
    better = F.concat(F.lit("h"), (c("before") + 1).cast("string"))
    none = F.lit(None).cast("string")
    fix = F.struct(
        F.lit("rename-tag").alias("strategy"), none.alias("attribute"), better.alias("value"), F.lit("review").alias("tier"), none.alias("old"), none.alias("backdrop")
    )
    out = findings_of(skipped, "heading-order", fix=fix)

    def again(rows: DataFrame, *by: str) -> DataFrame:
        return repeats(rows, ["page_id", *by], ["node_id"])

    ids = elements.withColumn("k", attrs["id"]).where("k <> ''")
    out = out.unionByName(findings_of(again(ids, "k"), "duplicate-id"))
    keys = elements.withColumn("k", F.lower(F.trim(attrs["accesskey"]))).where(attrs["accesskey"] != "")
    out = out.unionByName(findings_of(again(keys, "k"), "accesskey-duplicate", c("k")))
    seen = elements.where(~c("hidden_deep"))
    out = out.unionByName(findings_of(again(seen.where((c("tag") == "main") | (F.lower(attrs["role"]) == "main"))), "main-multiple"))
    out = out.unionByName(findings_of(again(seen.where("tag = 'h1'")), "h1-multiple"))
    # text that stands out too little: the first of each pair of colors and size
    shown = seen if painted_elements is None else painted_elements.where(~c("hidden_deep"))
    text = shown.where(c("facts")["fg"].isNotNull()).withColumns(
        {k: c("facts")[k] for k in ("fg", "bg")} | {"px": c("facts")["px"].cast("double"), "bold": c("facts")["bold"] == "true"}
    )
    need = required_ratio(c("px"), c("bold"))
    low = text.where(contrast_ratio(c("fg"), c("bg")) < need).withColumn("k", F.concat_ws("|", "fg", "bg", rounded(c("px"))))
    low = low.withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "k").orderBy("node_id"))).where("nth = 1")
    low = low.withColumn("better", suggested_color(c("fg"), c("bg"), need))
    better = c("better")
    fix = F.struct(
        F.when(better.isNull(), "manual").otherwise("css-color").alias("strategy"), F.when(better.isNotNull(), "color").alias("attribute"), better.alias("value"), F.lit("review").alias("tier"),
        c("fg").alias("old"), c("bg").alias("backdrop"),
    )
    return out.unionByName(findings_of(low, "color-contrast", fix=fix))


def join_findings(elements: DataFrame) -> DataFrame:
    """Rules on references between elements of a page: anti-joins on (page, id)."""
    c, attrs = F.col, F.col("attrs")
    ids = elements.select("page_id", attrs["id"].alias("target")).where("target <> ''").distinct()
    labels = elements.where("tag = 'label' and not hidden_deep").withColumn("target", attrs["for"]).where("target <> ''")
    out = findings_of(labels.join(ids, ["page_id", "target"], "left_anti"), "label-orphan")

    names = elements.select("page_id", attrs["name"].alias("target")).where("target <> ''").distinct()
    skips = elements.where((c("tag") == "a") & attrs["href"].startswith("#") & (F.length(attrs["href"]) > 1) & ~c("hidden_deep") & c("text").rlike("(?i)skip|jump"))
    skips = skips.withColumn("target", F.substring(attrs["href"], F.lit(2), F.length(attrs["href"])))
    lost = skips.join(ids.union(names), ["page_id", "target"], "left_anti")
    out = out.unionByName(findings_of(lost, "skip-link-target-missing"))

    named = F.filter(F.transform(F.array(*map(F.lit, REFERENCES)), lambda n: F.struct(n.alias("n"), attrs[n].alias("v"))), lambda x: x["v"].isNotNull())
    refs = elements.withColumn("ref", F.explode_outer(named)).where("ref is not null").select("*", c("ref.n").alias("attribute"), F.explode_outer(F.split("ref.v", r"\s+")).alias("target"))
    gone = refs.where("target <> ''").join(ids, ["page_id", "target"], "left_anti")
    gone = gone.select(*PLACE, "attribute").distinct()
    return out.unionByName(findings_of(gone, "aria-describedby-orphan", c("attribute")))


def group_findings(elements: DataFrame) -> DataFrame:
    """Rules on groups of elements of a page."""
    c, attrs = F.col, F.col("attrs")
    page_role = Window.partitionBy("page_id", "role")
    regions = elements.where(c("role").isin("navigation", "complementary", "region") & ~c("hidden_deep"))
    bare = (F.coalesce(attrs["aria-label"], F.lit("")) == "") & (F.coalesce(attrs["aria-labelledby"], F.lit("")) == "")
    regions = regions.withColumn("bare", bare).where("role <> 'region' or not bare")
    regions = regions.withColumn("n", F.count("*").over(page_role)).withColumn("n_bare", F.count_if("bare").over(page_role))
    out = findings_of(regions.where("n >= 2 and n_bare >= 2 and bare"), "landmark-unique")

    choices = elements.where((c("tag") == "input") & F.lower(attrs["type"]).isin("radio", "checkbox") & (F.coalesce(attrs["name"], F.lit("")) != "") & ~c("hidden_deep"))
    choices = choices.withColumn("k", F.concat_ws(":", F.lower(attrs["type"]), attrs["name"]))
    group = Window.partitionBy("page_id", "k")
    choices = choices.withColumn("n", F.count("*").over(group)).withColumn("nth", F.row_number().over(group.orderBy("node_id")))
    # the nearest set of fields, whose legend must say something, and the nearest group by role, which must have a name
    fields = F.get(F.filter("ancestors", lambda a: a["tag"] == "fieldset"), F.lit(0))
    grouped = F.get(F.filter("ancestors", lambda a: F.lower(a["role"]).isin("group", "radiogroup")), F.lit(0))
    held = F.coalesce(fields["legend"], F.lit(False)) | F.coalesce(grouped["named"], F.lit(False))
    lost = choices.where((c("n") >= 2) & (c("nth") == 1) & ~held)
    lost = lost.select("page_id", F.coalesce(fields["node_id"], c("node_id")).alias("node_id"), "k")
    out = out.unionByName(findings_of(elements.join(lost, ["page_id", "node_id"]), "fieldset-legend-missing", c("k")))

    links = elements.where((c("tag") == "a") & attrs["href"].isNotNull() & ~c("hidden_deep")).withColumn("k", F.lower(F.trim("acc_name"))).where(F.length("k") >= 3)
    links = links.withColumn("href", F.split_part(attrs["href"], F.lit("#"), F.lit(1)))
    many = several_targets(links, ["page_id", "k"])
    return out.unionByName(findings_of(links.join(many.drop("n"), ["page_id", "k", "node_id"], "left_semi"), "link-same-name-different-target", c("k")))


def measured_findings(elements: DataFrame, measurements: DataFrame | None, layout: DataFrame | None) -> list[DataFrame]:
    """Rules on what a browser measured; none without measurements.

    ``measurements(page_id, css_path, visible, width, height, interactive, display)`` and more (``measured_looks``),
    ``layout(page_id, scroll_width, client_width)``.
    """
    found = []
    if measurements is not None:
        small = elements.join(measurements, ["page_id", "css_path"]).where(
            "not hidden_deep and interactive and visible and (width < 24 or height < 24) and not (tag = 'a' and coalesce(display, '') = 'inline')"
        )
        small = small.withColumn("k", F.concat_ws("x", rounded(F.col("width")), rounded(F.col("height"))))
        first = Window.partitionBy("page_id", "k", "tag").orderBy("node_id")
        found.append(findings_of(small.withColumn("nth", F.row_number().over(first)).where("nth = 1"), "target-size-minimum"))
    if layout is not None:
        wide = elements.where("tag = 'body'").join(layout.where("scroll_width > client_width + 4"), "page_id", "left_semi")
        found.append(findings_of(wide, "horizontal-scroll"))
    return found


def find_all(elements: DataFrame, pages: DataFrame, measurements: DataFrame | None = None, layout: DataFrame | None = None) -> DataFrame:
    """Findings of all rules, with catalog columns and signatures.

    ``elements`` should be persisted or written: five passes read it.
    ``pages(page_id, url)`` gives the addresses.
    """
    # written down, as each use of a painted color would hold the whole of its making
    painted_elements = None if measurements is None else materialise(measured_looks(elements, measurements), "painted-elements")
    parts = [row_findings(elements), page_findings(elements), window_findings(elements, painted_elements), join_findings(elements), group_findings(elements)]
    parts += measured_findings(elements, measurements, layout)
    parts += [run(elements) for run in ADDED.values()]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    rules = F.broadcast(catalog(elements.sparkSession).drop("title"))
    rows = rows.join(rules, "rule_id").join(pages.select("page_id", "url"), "page_id")
    return rows.withColumn("signature", signature(F.col("rule_id"), F.col("url"), F.col("css_path"), F.col("key")))
