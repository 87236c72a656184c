"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from creditloom.llm.license_templates import templates
from creditloom.llm.licenses import VERSION_AT_END, VERSION_INSIDE

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_TEMPLATE_ROWS = ", ".join(
    "('{}', '{}')".format(name, text.replace("'", "''")) for name, text in templates()
)

#: Every window is compared, where the query retrieves them by MinHash.
LICENSES = rf"""
with t as (
  select row_number() over () tid, license, w
  from (select distinct license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') w
        from (values {_TEMPLATE_ROWS}) v(license, text))),
sets as (
  select distinct tid, license, n, k, array_to_string(list_slice(w, p + 1, p + k), ' ') sh
  from (select *, unnest(range(n - k + 1)) p
        from (select tid, license, w, len(w) n, least(5, len(w)) k from t))),
named as (
  select *, regexp_matches(sh, '{VERSION_INSIDE}') inside, regexp_matches(sh, '{VERSION_AT_END}') at_end
  from sets),
marked as (
  select *, case when bool_or(inside) over (partition by tid) then inside else at_end end must
  from named),
needed as (
  select tid, count(*) n_sh, count(*) filter (must) n_must from marked group by tid),
d as (
  select doc_id, x, regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+') w
  from (select distinct doc_id, text x from documents where text is not null)),
places as (
  select doc_id, x, k, p, array_to_string(list_slice(w, p + 1, p + k), ' ') sh
  from (select doc_id, x, w, k, unnest(range(len(w) - k + 1)) p
        from d, (select distinct k from sets) where len(w) >= k)),
hits as (
  select doc_id, x, tid, license, n, k, p, sh, must, greatest(1, n // 8) step
  from places join marked using (k, sh)),
windows as (
  select *, unnest(range(
           greatest(0, ceil((p - (n + step - 1 - k)) / step)::bigint) * step, p + 1, step)) b
  from hits),
found as (
  select doc_id, x, tid, license, n, b, count(distinct sh) shared,
         count(distinct sh) filter (must) versions, min(p) first, max(p + k) last
  from windows group by doc_id, x, tid, license, n, b),
good as (
  select *, shared / n_sh::double c from found join needed using (tid)
  where shared >= 0.8 * n_sh and 2 * versions >= n_must),
counted as (
  select doc_id, x, license, count(distinct (n, b)) n_windows from good group by all),
best as (
  select *, row_number() over (
           partition by doc_id, x, license order by c desc, shared desc, first, last) place
  from good),
one as (select * from best join counted using (doc_id, x, license) where place = 1)
select doc_id, license, c containment, first::bigint word_start, last::bigint word_end, n_windows
from one a
where not exists (
  from one b where a.doc_id is not distinct from b.doc_id and a.x = b.x and a.license <> b.license
  and b.first <= a.first and b.last >= a.last and b.shared > a.shared)
"""

QUALITY = r"""
with d as (
  select row_number() over () r, doc_id, coalesce(text, '') x,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w
  from documents),
lines as (
  select r, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls
  from d),
places as (select r, w, unnest(range(len(w) - 7)) p from d where len(w) > 7),
wins as (select r, p, list_slice(w, p + 1, p + 8) g from places),
twice as (select r, unnest(list(p)) p from wins group by r, g having count(*) > 1),
hit as (
  select r, count(distinct q) n
  from (select r, unnest(range(p, p + 8)) q from twice) group by r),
counted as (
  select d.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
         length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols,
         len(ls)::bigint n_lines, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
         coalesce(hit.n, 0)::bigint n_repeat_words,
         length(regexp_replace(x, '[^\p{L}]+', '', 'g')) letters,
         length(regexp_replace(x, '[^\p{Lu}]+', '', 'g')) capitals,
         len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) stutters
  from d join lines using (r) left join hit using (r)),
judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed,
         10 * n_symbols > n_words or 2 * n_dup_lines > n_lines or word_chars < 2 * n_words
         or word_chars > 15 * n_words or 2 * letters < word_chars or 2 * capitals > letters
         or 3 * stutters > n_words broken
  from counted)
select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not broken kept
from judged
"""

DECONTAMINATION = rf"""
with cut as (
  select 'd' kind, row_number() over () r, doc_id id, text from documents
  union all select 'b', row_number() over (), item_id, text from benchmark),
w as (
  select kind, r, id, regexp_extract_all(
           translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from cut),
items as (select id, w, least(13, len(w)) n from w where kind = 'b' and len(w) > 0 and id is not null),
wins as (
  select distinct id, n, list_slice(w, p + 1, p + n) g
  from (select *, unnest(range(len(w) - n + 1)) p from items)),
sizes as (select distinct n from wins),
places as (
  select r, n, p, list_slice(w, p + 1, p + n) g
  from (select r, w, n, unnest(range(len(w) - n + 1)) p
        from w, sizes where kind = 'd' and len(w) >= n)),
found as (select r, places.n, p, id from places join wins using (g)),
hit as (
  select r, count(distinct q) n_hit
  from (select r, unnest(range(p, p + n)) q from found) group by r),
named as (
  select r, count(*) n_items, string_agg(s, ',' order by s) ids
  from (select distinct r, id::varchar s from found) group by r)
select id doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit,
       coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from w left join hit using (r) left join named using (r)
where kind = 'd'
"""

WARC = """
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint payload_bytes,
         sha256(coalesce(html, '')) payload_digest
  from pages),
f as (
  select *, min(page_id) over (partition by payload_digest) first_id from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end
         record_type,
       case when payload_bytes >= 100 and page_id <> first_id then first_id end refers_to
from f
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    start, poly = 0xFFFFFFFF, 0xEDB88320
    eight = f"lambda x, _: xor(x >> 1, (x & 1) * {poly})"
    byte = f"lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], {eight})"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)"
    return f"xor(list_reduce(list_prepend({start}::bigint, {codes}), {byte}), {start})"


#: All paths through the grammar are followed; nothing is pruned.
CONVERSATIONS = rf"""
with recursive given as (
  select dense_rank() over (order by conv_id nulls first) g, conv_id, turn,
         coalesce(role, ' ') role, coalesce(text, ' ') text,
         {_crc32("concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' '))")} % 20 k
  from conversations),
damaged as (
  select g, turn, case when k = 4 then 'user' else role end role,
         case when k = 1 then '' when k = 2 then translate(text, '.!?', '') else text end text,
         unnest(case k when 0 then [] when 3 then [1, 2] else [1] end) copy
  from given),
placed as (
  select *, row_number() over (partition by g order by turn nulls first, role, sha256(text), copy) i,
         row_number() over (partition by g, role, text order by turn nulls first, copy) nth,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) tail
  from damaged),
rows_of as (
  select g, i, turn, role, text, left(role, 1) ini,
         lag(left(role, 1)) over (partition by g order by i) || left(role, 1) pair,
         case when tail = '' then 'blank' when nth > 1 then 'duplicate'
              when tail not in ('.', '!', '?') then 'truncated' else '' end fault
  from placed),
counts as (
  select g, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps,
         count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') duplicate,
         count(*) filter (fault = 'truncated') truncated,
         count(*) filter (pair not in ('su', 'ua', 'au')) illegal, count(*) n
  from rows_of group by g),
inserted(st, mid, paid, ins) as (values
  ('E', 'E', 0, ''), ('E', 'U', 5, 'I'), ('E', 'A', 10, 'II'), ('S', 'S', 0, ''), ('S', 'U', 5, 'I'),
  ('S', 'A', 10, 'II'), ('U', 'U', 0, ''), ('U', 'A', 5, 'I'), ('A', 'A', 0, ''), ('A', 'U', 5, 'I')),
edits(mid, needs, nxt, price, ed) as (values
  ('E', 's', 'S', 0, 'K'), ('E', 'u', 'U', 0, 'K'), ('S', 'u', 'U', 0, 'K'), ('A', 'u', 'U', 0, 'K'),
  ('U', 'a', 'A', 0, 'K'), ('E', null, 'U', 1, 'R'), ('S', null, 'U', 1, 'R'), ('A', null, 'U', 1, 'R'),
  ('U', null, 'A', 1, 'R'), ('E', null, 'E', 2, 'D'), ('S', null, 'S', 2, 'D'), ('U', null, 'U', 2, 'D'),
  ('A', null, 'A', 2, 'D')),
best(g, i, st, way) as (
  select distinct g, 0::bigint, 'E', {{'c': 0, 'a': ''}} from given
  union all
  select b.g, b.i + 1, nxt,
         min({{'c': way.c + paid + price + case when ed <> 'D' and fault = 'truncated' then 5 else 0 end,
               'a': way.a || ins || ed}})
  from best b join rows_of r on r.g = b.g and r.i = b.i + 1 join inserted using (st) join edits using (mid)
  where (needs is null or needs = ini) and (ed = 'D' or fault not in ('blank', 'duplicate'))
  group by b.g, b.i + 1, nxt),
ends as (
  select b.g, min({{'c': way.c + paid, 'a': way.a || ins}}) way
  from best b join inserted using (st) left join counts on counts.g = b.g
  where b.i = coalesce(n, 0) and mid in ('E', 'A') group by b.g),
marks as (
  select g, unnest(string_split(way.a, '')) ed, unnest(range(len(way.a))) nr from ends where way.a <> ''),
numbered as (
  select *, sum(case when ed = 'I' then 0 else 1 end) over (partition by g order by nr) i from marks),
kept as (
  select m.g, ed, r.role, r.ini, case when ed = 'I' then '' else text end text,
         row_number() over (partition by m.g order by nr) place
  from numbered m left join rows_of r on r.g = m.g and r.i = m.i where ed <> 'D'),
headed as (select *, max(case when place = 1 and ed = 'K' and ini = 's' then 1 else 0 end) over (partition by g) s from kept),
lines as (
  select g, string_agg(case when ed = 'K' then role when (place - s) % 2 = 1 then 'user' else 'assistant' end
                       || ':' || text, chr(10) order by place) x
  from headed group by g)
select conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate,
       coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, way.c::bigint "cost", way.a audit,
       sha256(coalesce(x, '')) repaired_sha256
from (select distinct g, conv_id from given) left join counts using (g) join ends using (g) left join lines using (g)
"""

#: Prefixes are lists of whole turns.
TRIE = rf"""
with turns as (
  select conv_id, coalesce(role, '') r, coalesce(text, '') x,
         row_number() over (partition by conv_id order by turn nulls first, sha256(
           concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) i
  from conversations where conv_id is not null),
own as (
  select conv_id c, list({{'r': r, 'x': x}} order by i) t, {_crc32("conv_id::varchar")} % 6 h
  from turns group by conv_id),
built as (
  select own.c, list_concat(coalesce(list_slice(b.t, 1, own.h), []),
                            list_slice(own.t, own.h + 1, len(own.t))) t
  from own left join own b on b.c = own.c - own.c % 100),
members as (
  select c, d, list_slice(t, 1, d) p from (select c, t, unnest(range(len(t) + 1)) d from built)),
nodes as (
  select p, d, min(c) c, count(*) n,
         case when d > 0 then (count(*) - 1) * length(p[d].x) else 0 end own
  from members group by p, d),
kids as (select list_slice(p, 1, d - 1) p, count(*) k from nodes where d > 0 group by 1),
below as (select p, own, unnest(range(d + 1)) top from nodes),
sums as (
  select list_slice(below.p, 1, top) p, sum(own)::bigint saved, count(*) filter (k is null) leaves
  from below left join kids using (p) group by 1),
ends as (select t p, string_agg(c::varchar, ',' order by c) ids from built group by t)
select n.c conv_id, n.d depth, up.c parent_conv_id, n.n n_convs, coalesce(k, 0) n_children,
       leaves n_leaves, saved saved_tokens, sha256(coalesce(ids, '')) ends_sha256
from nodes n join sums using (p) left join kids using (p) left join ends using (p)
left join nodes up on n.d > 0 and up.p = list_slice(n.p, 1, n.d - 1)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op12_conversation_repair": CONVERSATIONS,
        "op13_prefix_trie": TRIE,
        "op1_license_scan": LICENSES,
        "op2_quality_rules": QUALITY,
        "op4_decontamination": DECONTAMINATION,
        "op7_warc": WARC,
    }
