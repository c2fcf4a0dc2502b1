"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
with d as (select doc_id, {WORDS} as ws from documents),
b as (select cast(item_id as varchar) as item, {WORDS} as ws from benchmark where text is not null),
n as (select item, ws, least(13, len(ws)) as n from b where len(ws) > 0),
w as (select distinct item, n, array_to_string(ws[i:i + n - 1], ' ') as key from (select item, ws, n, unnest(range(1, len(ws) - n + 2)) as i from n)),
p as (select doc_id, m.n, i, array_to_string(ws[i:i + m.n - 1], ' ') as key
  from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from d) join (select distinct n from w) m on i + m.n - 1 <= len(ws)),
h as (select doc_id, i, p.n, item from p join w on p.n = w.n and p.key = w.key),
c as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(i, i + n)) as x from h) group by 1),
t as (select doc_id, count(distinct item) as n_items, list_sort(list(distinct item)) as items from h group by 1)
select d.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(array_to_string(items, ','), '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join c on c.doc_id = d.doc_id left join t on t.doc_id = d.doc_id
"""

MINHASH = f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
linked as (select a, b from e union select b, a from e),
r(doc_id, root) as (select doc_id, doc_id from d union select linked.b, root from r join linked on linked.a = r.doc_id),
c as (select doc_id, min(root) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from d join c on c.doc_id = d.doc_id left join n on n.doc_id = d.doc_id
"""

_phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
_templates = ", ".join(f"({i}, '{label}', '{t}')" for i, (label, t) in enumerate(TEMPLATES))
LICENSES = f"""
with d as (select doc_id, {WORDS} as ws from documents),
f(phrase, label) as (values {_phrases}),
b as (select doc_id, label, i - 1 as place from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from d) join f
  on ws[i] = split_part(phrase, ' ', 1) and array_to_string(ws[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
t(id, label, words) as (values {_templates}),
k as (select id, label, unnest(list_distinct(string_split(words, ' '))) as w from t),
m as (select id, count(*) as size from k group by 1),
l as (select doc_id, row_number() over () as line, {WORDS} as ws from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as text from documents)),
x as (select distinct doc_id, line, unnest(ws) as w from l),
c as (select doc_id, line, id, k.label, count(*) as n from x join k using (w) group by all),
y as (select doc_id, label, n / size as share from c join m using (id) where n >= ceil(0.9 * size - 1e-9)),
base as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, array_to_string(list_sort(list(distinct label)), ',') as base_labels from b group by 1),
every as (select doc_id, array_to_string(list_sort(list(distinct label)), ',') as labels, max(share) as score
  from (select doc_id, label, 1.0::double as share from b union all select doc_id, label, share from y) group by 1)
select d.doc_id, len(ws) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
  coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
from d left join base on base.doc_id = d.doc_id left join every on every.doc_id = d.doc_id
"""

SEARCH = rf"""
with d as (select row_number() over () as r, doc_id, {WORDS} as ws from documents),
z as (select r, doc_id, len(ws) as n from d where len(ws) > 0),
g as (select count(*) as docs, cast(sum(n) as bigint) as terms from z),
p as (select r, w, count(*) as tf from (select r, unnest(ws) as w from d) group by all),
f as (select w, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as weight from p, g group by w, docs),
i as (select row_number() over () as k, item_id, {WORDS} as ws from benchmark),
q as (select k, w, count(*) as times from (select k, unnest(ws) as w from i) group by all),
s as (select k, r, cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) as bigint) as score
  from q join f using (w) join p using (w) join z using (r), g group by all),
o as (select k, doc_id, score, row_number() over (partition by k order by score desc, doc_id) as rank from s join z using (r) where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from o join i using (k) where rank <= 20
"""

SPELLING = f"""
with recursive bits(i, c, step) as (
  select range, range, 0 from range(256)
  union all select i, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, step + 1 from bits where step < 8),
crc as (select list(c order by i) as t from bits where step = 8),
runs as (select doc_id, w, count(*) as n from (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[A-Za-z\u00C0-\u00FF]+')) as w from documents) group by all),
h as (select w, n, length(w) as size, xor(4294967295, list_reduce(
  list_prepend(4294967295, list_transform(range(1, octet_length(key) + 1), lambda i: cast('0x' || substr(hex(key), 2 * i - 1, 2) as bigint))),
  lambda c, b: xor(c >> 8, t[cast((xor(c, b) & 255) + 1 as bigint)]))) as h
  from (select w, n, encode(coalesce(cast(doc_id as varchar), '') || ':' || w) as key from runs), crc),
v as (select word, cast(sum(n) as bigint) as n from (
  select n, case when h % 199 = 0 then substr(w, 1, h % size) || substr(w, h % size + 2) else w end as word from h) where length(word) >= 6 group by 1 having sum(n) >= 5),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from v),
cut as (select word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) as hole, substr(word, 1, i - 1) || substr(word, i + 1) as rest from places),
near as (
  select a.word, b.word as other, b.n as m from cut a join cut b on a.hole = b.hole and a.word <> b.word
  union select c.word, v.word, v.n from cut c join v on c.rest = v.word
  union select v.word, c.word, c.n from cut c join v on c.rest = v.word),
best as (select word, count(*) as n_near, max(m) as m, first(other order by m desc, encode(other)) as other from near group by 1),
x as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when m >= 5 * v.n then other end as form, case when m >= 5 * v.n then m end as form_n from v left join best using (word)),
walk(word, place) as (select word, word from x union all select walk.word, x.form from walk join x on x.word = walk.place where x.form is not null),
ends as (select walk.word, walk.place as root from walk join x on x.word = walk.place where x.form is null)
select x.word, form, root, n, n_near, form_n from x join ends using (word)
"""

# reads the markup that the tables hold: one article a page, of headings and paragraphs
EXTRACTION = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) as body from pages),
b as (select page_id, url, list_transform(regexp_split_to_array(body, '</?(p|h1)>'), lambda t: trim(regexp_replace(
  replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) as blocks from a),
t as (select page_id, url, array_to_string(list_filter(blocks, lambda t: t <> ''), chr(10)) as text from b)
select page_id, url, text, length(text) as n_chars from t
"""

ORACLES = {
    "op3_decontamination": DECONTAMINATION, "op8_minhash": MINHASH, "op10_licenses": LICENSES, "op11_search": SEARCH, "op12_spelling": SPELLING,
    "op13_extraction": EXTRACTION,
}
