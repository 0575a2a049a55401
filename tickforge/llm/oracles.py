"""DuckDB SQL for the text operators that SQL can express."""

from __future__ import annotations

from .quality import COMMON_WORDS, Divergence
from .url_rules import BLOCK_WORDS, LIST_RULES

ORACLES: dict[str, str] = {}


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))


ORACLES["op1_separator_scan"] = r"""
select doc_id, (coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) + 1)::bigint as n_tokens from documents
"""

ORACLES["op3_warc_chunks"] = """
with p as (
  select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as digest from pages
), k as (
  select digest, max(page_id) as keep from p where n >= 1000 group by digest having count(*) > 1
)
select page_id, n::bigint as payload_bytes, p.digest as payload_digest,
       case when page_id < keep then 'revisit' else 'response' end as record_type, case when page_id < keep then keep end as refers_to
from p left join k on p.digest = k.digest and p.n >= 1000
"""

_D = Divergence()

ORACLES["op4_distribution_divergence"] = rf"""
with d as (
  select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
), c as (
  select rid, doc_id, lang, t, w, len(w) as n_words, length(t) as n_chars,
         length(array_to_string(w, '')) as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
         len(regexp_extract_all(t, '\p{{Lu}}')) as upper_n,
         len(regexp_extract_all(t, '[0-9]')) as digit_n,
         len(regexp_extract_all(t, '[.,;:!?''"()-]')) as punct_n
  from d
), l as (
  select rid, count(*) - count(distinct line) as n_dup_lines
  from (select rid, unnest(string_split(t, chr(10))) as line from c)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid
), g as (
  select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as win
  from (select rid, w, unnest(range(1, len(w) - 1)) as i from c where len(w) >= 3)
), r as (
  select rid, count(distinct pos) as n_repeat_words
  from (select rid, i + unnest([0, 1, 2]) as pos from (select *, count(*) over (partition by rid, win) as n from g) where n >= 2)
  group by rid
), bins as (
  select *, n_chars - word_chars as space_n,
         n_chars - upper_n - digit_n - punct_n - n_symbols - (n_chars - word_chars) as rest_n
  from c
), cls as (
  select rid, lang, 0 as kind, k as bin, [upper_n, digit_n, punct_n, n_symbols, space_n, rest_n][k]::double as n, greatest(n_chars, 1)::double as total
  from bins, (select unnest([1, 2, 3, 4, 5, 6]) as k)
), common as (
  select rid, word, count(*) as n from (select rid, unnest(w) as word from c)
  where word in ({_list(_D.common)}) group by rid, word
), langs as (
  select lang, sum(n_words) as n_words, sum(n_chars) as n_chars from c where lang is not null group by lang having sum(n_words) > 0 and sum(n_words) >= {_D.min_share} * (select sum(n_words) from c where lang is not null)
), cmed as (
  select lang, bin, quantile_disc((1000 * n::bigint) // n_chars, 0.5) + 0.5 as m
  from cls join (select rid, n_chars from c) using (rid) where n_chars >= {_D.min_chars} and lang is not null group by lang, bin
), cref as (
  select lang, bin, m / sum(m) over (partition by lang) as q from cmed
), wref as (
  select lang, word, sum(n)::double / any_value(n_words_lang) as q
  from common join (select rid, lang from c) using (rid) join (select lang, n_words as n_words_lang from langs) using (lang) group by lang, word
), cjs as (
  select rid, langs.lang as ref, sum(
    (case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2) as js
  from (select rid, bin, n / total as p from cls) x join cref using (bin) join langs on langs.lang = cref.lang
  group by rid, langs.lang
), pairs as (
  select c.rid, langs.lang as ref, greatest(c.n_words, 1)::double as nw from c, langs
), wjs as (
  select rid, ref, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2 as js
  from (
    select rid, ref, word, coalesce(common.n, 0) / nw as p, wref.q as q
    from pairs join wref on wref.lang = ref left join common using (rid, word)
    union all
    select rid, ref, word, common.n / nw as p, 0 as q
    from pairs join common using (rid) where not exists (select 1 from wref where wref.lang = ref and wref.word = common.word)
    union all
    select rid, ref, '', greatest(1 - coalesce((select sum(n) from common where common.rid = pairs.rid), 0) / nw, 0),
           greatest(1 - coalesce((select sum(q) from wref where wref.lang = ref), 0), 0)
    from pairs
  ) group by rid, ref
), dist as (
  select rid, min(sqrt(greatest(cjs.js, 0))) as cd, min(sqrt(greatest(wjs.js, 0))) as wd
  from cjs join wjs using (rid, ref) group by rid
), v as (
  select c.*, coalesce(n_dup_lines, 0) as dup, coalesce(n_repeat_words, 0) as rep,
         c.n_words < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * c.n_words as failed, cd, wd
  from c left join l using (rid) left join r using (rid) left join dist using (rid)
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, dup::bigint as n_dup_lines,
       rep::bigint as n_repeat_words, failed as base_failed,
       not failed and (n_chars < {_D.min_chars} or coalesce(cd <= {_D.max_char_distance}, true))
                  and (n_words < {_D.min_words} or coalesce(wd <= {_D.max_word_distance}, true)) as kept
from v
"""

_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op5_aho_corasick"] = rf"""
with b as (
  select coalesce(item_id::varchar, 'null') as item, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null
), win as (
  select distinct item, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as run
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)
), d as (
  select row_number() over () as rid, doc_id, coalesce(regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents
), g as (
  select rid, n, i, array_to_string(w[i : i + n - 1], ' ') as run
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from win) where len(w) >= n)
), h as (select g.rid, g.n, g.i, win.item from g join win using (n, run)),
pos as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from (select distinct rid, i, n from h)) group by rid),
its as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct rid, item from h) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (rid) left join its using (rid)
"""

ORACLES["op6_jaccard_join"] = r"""
with recursive d as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select distinct rid, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') as g
  from (select rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)
), n as (select rid, count(*) as n from s group by rid),
links as (
  select x.rid as a, y.rid as b from s x join s y using (g) where x.rid <> y.rid group by 1, 2
  having 100 * count(*) >= 80 * ((select n from n where n.rid = x.rid) + (select n from n where n.rid = y.rid) - count(*))
), reach as (
  select rid as a, rid as b from d union select reach.a, links.b from reach join links on links.a = reach.b
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id
from d left join n using (rid) join (select a as rid, min(e.doc_id) as component_id from reach join d e on e.rid = reach.b group by a) m using (rid)
"""

# DuckDB has no crc32: the checksum is folded over the bytes, with the table of the reflected polynomial made from its rule.
_CRC_TABLE = """tab as (
  select list(c order by b) as t from (
    select b, list_reduce([b::bigint, 1, 1, 1, 1, 1, 1, 1, 1],
      lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as c
    from (select unnest(range(0, 256)) as b))
)"""


def _crc(hexed: str) -> str:
    """CRC-32 of a hexadecimal text's bytes, with the table ``t``."""
    return f"""xor(list_reduce([4294967295::bigint] || list_transform(range(0, length({hexed}) // 2), lambda i: ('0x' || {hexed}[2 * i + 1 : 2 * i + 2])::bigint),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"""


ORACLES["op8_stratified_shards"] = rf"""
with recursive {_CRC_TABLE}, base as (
  select row_number() over () as rid, doc_id, coalesce('=' || source, '') as s, strlen(coalesce(text, '')) + 1 as size,
         hex(encode(coalesce(text, ''))) as x from documents
), crc as (
  select rid, {_crc('x')} as text_crc32
  from base, tab
), f as (
  select *, (row_number() over (partition by s order by h, doc_id, size, text_crc32) - 1 + 0.5::double) / count(*) over (partition by s) as f
  from (select *, ('0x' || md5('mixture-1:' || coalesce(doc_id::varchar, '') || ':' || size || ':' || text_crc32)[1:15])::bigint as h from base join crc using (rid))
), p as (
  select *, row_number() over (order by f, s, h, doc_id, size, text_crc32) - 1 as pos, count(*) over () as n from f
)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'rows' as law, (pos * 8 // n)::int as shard,
       (pos - ((pos * 8 // n) * n + 7) // 8)::bigint as slot, null::int as grown_shard
from p
"""

_rules = ", ".join(f"('{r.name}', '{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}', '{r.verdict}')" for r in LIST_RULES)
ORACLES["op10_url_rules"] = rf"""
with u as (
  select row_number() over () as rid, page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), rules(name, h, p, v) as (values {_rules}),
fit as (
  select rid, arg_max(name, length(name)) as name, arg_max(v, length(name)) as v
  from u join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by rid
)
select page_id, host, path, name as rule,
       coalesce(v, case when regexp_matches(lower(host || path), '(^|[^a-z0-9])({"|".join(BLOCK_WORDS)})([^a-z0-9]|$)') then 'block' else 'allow' end) as verdict
from u left join fit using (rid)
"""

ORACLES["op13_spelling_variants"] = rf"""
with recursive {_CRC_TABLE}, runs as (
  select id, run, count(*) as k from (
    select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
    from documents)
  where length(run) >= 7 group by id, run
), hashed as (
  select run, k, {_crc('x')} as h from (select *, hex(encode(id || ':' || run)) as x from runs), tab
), spelled as (
  select k, case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed
), w as (
  select word, sum(k)::bigint as n from spelled where length(word) >= 7 group by word having sum(k) >= 2
), cut as (
  select word, i, substr(word, 1, i::int) || substr(word, i::int + 2) as rest from (select word, unnest(range(0, length(word))) as i from w)
), pairs as (
  select x.word as a, y.word as b from cut x join cut y on x.i = y.i and x.rest = y.rest and x.word <> y.word
  union select word, rest from cut where rest in (select word from w)
  union select rest, word from cut where rest in (select word from w)
), best as (
  select a, count(*) as n_near, (list(b order by w.n desc, b))[1] as form, max(w.n) as form_n from pairs join w on w.word = b group by a
), v as (
  select word, n, coalesce(n_near, 0) as n_near, case when form_n >= 10 * n then form end as form, case when form_n >= 10 * n then form_n end as form_n from w left join best on a = word
), walk as (
  select word, word as at from v union all select walk.word, v.form from walk join v on v.word = walk.at where v.form is not null
)
select v.word, v.form, walk.at as root, v.n, v.n_near::bigint as n_near, v.form_n
from v join walk on walk.word = v.word where walk.at in (select word from v where form is null)
"""
