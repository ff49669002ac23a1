"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Base 32 of a SHA-1 in hexadecimal: four letters for each five digits.
_DIGITS = [f"cast('0x' || substr(x, {5 * k + 1}, 5) as integer)" for k in range(8)]
_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({d} // {32**n}) % 32 + 1, 1)" for d in _DIGITS for n in (3, 2, 1, 0)
)

OP2 = f"""
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x from pages),
f as (select h, min(page_id) as first from p group by h)
select page_id, cast(octet_length(encode(p.h)) as bigint) as payload_bytes, {_LETTERS} as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from p join f on p.h = f.h
"""

#: The given tables hold whole vectors only.
OP9 = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
      where list_cosine_similarity(a.e, b.e) >= 0.93),
r as (select vec_id as v, vec_id as c from v union select r.v, l.b from r join l on r.c = l.a),
c as (select v, min(c) as component_id from r group by v),
n as (select a, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from v join c on vec_id = c.v left join n on vec_id = n.a
"""

#: Windows of ten words, or of all of a shorter item, are looked up in the documents' windows of that length.
OP7 = rf"""
with d as (select doc_id, coalesce({_WORDS}, []) as w from documents),
i as (select item_id, {_WORDS} as w from benchmark where text is not null),
iw as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as s from i where len(w) > 0)
),
sizes as (select distinct n from iw),
dw as (
  select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes where len(w) >= n)
),
occ as (select doc_id, item_id, s, dw.n from dw join iw on dw.n = iw.n and dw.win = iw.win),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from occ) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names
        from (select distinct doc_id, cast(item_id as varchar) as item_id from occ) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, n_hit is not null as contaminated
from d left join hit on d.doc_id = hit.doc_id left join its on d.doc_id = its.doc_id
"""

OP12 = r"""
with d as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
win as (select r, s, array_to_string(w[s:s + 34], ' ') as x
        from (select r, w, unnest(range(1, len(w) - 33)) as s from d where len(w) >= 35)),
rep as (select x from win group by x having count(*) > 1),
hit as (select distinct r, unnest(range(s, s + 35)) as p from win join rep on win.x = rep.x),
words as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select r, string_agg(word, ' ' order by p) as k, count(*) as n from words anti join hit using (r, p) group by r)
select doc_id, cast(len(w) as bigint) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(k, '')) as kept_sha256
from d left join kept on d.r = kept.r
"""

OP11 = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents where text is not null),
tok as (select doc_id, unnest(t) as term from d),
tf as (select doc_id, term, count(*) as tf from tok group by doc_id, term),
len as (select doc_id, count(*) as n from tok group by doc_id),
s as (select count(*) as n_docs, cast(sum(n) as bigint) as total from len),
df as (select term, count(*) as df from tf group by term),
i as (select distinct item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark where text is not null),
w as (select item_id, term, cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w from i join df using (term), s),
m as (select doc_id, 100 - 90 + ((90 * n * n_docs) // total) as m from len, s),
sc as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
       from w join tf using (term) join m using (doc_id) group by item_id, doc_id),
r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from sc where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 10
"""

#: The given tables hold whole vectors only.
OP13 = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
             list_transform(cast(embedding as double[]), lambda x: floor(256 * x)) as e
           from embeddings where label is not null and embedding is not null),
s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, cast(list_inner_product(a.e, b.e) as bigint) as s
      from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select a, b, s from s where same qualify row_number() over (partition by a order by s desc, b) <= 5),
n as (select p.a, p.b, s.b as n, p.s as ps, s.s as ns, row_number() over (partition by p.a, p.b order by s.s desc, s.b) as rank
      from p join s on p.a = s.a and not s.same and 80 * p.s <= 100 * s.s and 100 * s.s <= 100 * p.s)
select a as anchor_id, b as positive_id, cast(rank as integer) as rank, n as negative_id, ps as positive_score, ns as negative_score
from n where rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2, "op7_contamination": OP7, "op9_embedding_dedup": OP9, "op11_lexical_search": OP11, "op12_substring_dedup": OP12, "op13_hard_negatives": OP13}
