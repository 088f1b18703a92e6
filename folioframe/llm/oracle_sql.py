"""DuckDB SQL for the contract queries that SQL can express: whole tables, by brute force."""

from __future__ import annotations

from . import quality_rules as rules

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

#: All strings of 400 bytes (taken from pieces of a text, so that slices are short) by their hash; a byte goes if one of the strings that cover it is found twice.
SUFFIX_DEDUP = """with d as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
 e as (select doc_id, q, x[2000 * q + 1 : 2000 * q + 2798] z from d, unnest(range(0, (length(x) // 2 + 999) // 1000)) v(q)),
 b as materialized (select doc_id, 1000 * q + r p, z[2 * r - 1 : 2 * r] y, case when 2 * r + 798 <= length(z) then md5(z[2 * r - 1 : 2 * r + 798]) end h from e, unnest(range(1, least(1000, length(z) // 2) + 1)) u(r)),
 t as (select h from b where h is not null group by h having count(*) > 1),
 c as (select doc_id, p, y, max(case when t.h is null then 0 else 1 end) over (partition by doc_id order by p rows between 399 preceding and current row) gone from b left join t using (h)),
 s as (select *, case when gone = 1 and coalesce(lag(gone) over (partition by doc_id order by p), 0) = 0 then 1 else 0 end first from c),
 k as (select doc_id, sum(gone)::bigint n_removed, sum(first)::bigint n_spans, string_agg(y, '' order by p) filter (gone = 0) kept from s group by all)
 select doc_id, (length(x) // 2)::bigint n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, ''))) kept_sha256 from d left join k using (doc_id)"""

#: All windows of 50 words by their hash and the least id that holds them.
SUBSTRING_DEDUP = f"""with d as (select doc_id, {_WORDS} w from documents),
 b as materialized (select doc_id, p, w[p] y, case when p + 49 <= len(w) then md5(array_to_string(w[p : p + 49], ' ')) end h from d, unnest(range(1, len(w) + 1)) u(p)),
 t as (select h, min(doc_id) least from b where h is not null group by h),
 c as (select doc_id, p, y, max(case when least < doc_id then 1 else 0 end) over (partition by doc_id order by p rows between 49 preceding and current row) gone from b left join t using (h)),
 k as (select doc_id, sum(gone)::bigint n_removed, string_agg(y, ' ' order by p) filter (gone = 0) kept from c group by all)
 select doc_id, len(w)::bigint n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join k using (doc_id)"""

#: Different sets of shingles, all pairs that share one, and the closure of the links.
JACCARD_JOIN = f"""with recursive d as (select doc_id, {_WORDS} w from documents),
 s as (select doc_id, list_sort(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p : p + 4], ' ')) else [array_to_string(w, ' ')] end)) g from d where len(w) > 0),
 m as materialized (select md5(array_to_string(g, chr(10))) sid, any_value(g) g, len(any_value(g)) n, count(*) copies, min(doc_id) least from s group by md5(array_to_string(g, chr(10)))),
 e as materialized (select sid, n, copies, unnest(g) x from m),
 l as materialized (select a.sid a, b.sid b, any_value(b.copies) copies from e a join e b on a.x = b.x and a.sid <> b.sid group by a.sid, b.sid having count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-6),
 r(node, other) as (select sid, sid from m union select r.node, l.b from r join l on l.a = r.other),
 c as (select node, min(least) class_id from r join m on m.sid = r.other group by node),
 k as (select a, sum(copies) docs, count(*) texts from l group by a),
 o as (select doc_id, md5(array_to_string(g, chr(10))) sid from s)
 select doc_id, coalesce(class_id, doc_id) class_id, (case when o.sid is null then 0 else coalesce(docs, 0) + m.copies - 1 end)::bigint n_links, coalesce(texts, 0)::bigint n_text_links
 from documents left join o using (doc_id) left join m on m.sid = o.sid left join c on c.node = o.sid left join k on k.a = o.sid"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _quality() -> str:
    known = _list(sorted({x for ws in (*rules.COMMON.values(), rules.OTHER) for w in ws for x in (w, w.capitalize())}))
    listed = "case lang " + " ".join(f"when '{k}' then {_list(v)}" for k, v in rules.COMMON.items()) + f" else {_list(rules.OTHER)} end"
    total = lambda c: f"list_sum({c})"
    shares = lambda c: f"list_transform({c}, lambda v: case when {total(c)} > 0 then v / {total(c)} else 0.0 end)"

    def distance(p: str, q: str) -> str:
        part = lambda x: f"case when {x} > 0 then {x} * log2({x} / ((z[1] + z[2]) / 2)) else 0 end"
        return f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: ({part('z[1]')} + {part('z[2]')}) / 2))))"

    means = lambda c, n: "[" + ", ".join(f"avg({c}[{i + 1}])" for i in range(n)) + "]"
    return f"""with d as (select doc_id, coalesce(lang, '') lang, coalesce(text, '') t, {_WORDS} w from documents),
 u as (select doc_id, p, w[p] || chr(32) || w[p + 1] || chr(32) || w[p + 2] g from d, unnest(range(1, len(w) - 1)) x(p)),
 n as (select *, count(*) over (partition by doc_id, g) > 1 twice from u),
 v as (select distinct doc_id, p + o q from n, unnest([0, 1, 2]) x(o) where twice),
 rw as (select doc_id, count(*) n_repeat_words from v group by all),
 ln as (select doc_id, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]')) y from d),
 c as (select doc_id, lang, len(w)::bigint n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols, (len(y) - len(list_distinct(y)))::bigint n_dup_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words,
  length(regexp_replace(t, '\\P{{Ll}}+', '', 'g')) low, length(regexp_replace(t, '\\P{{Lu}}+', '', 'g')) up, length(regexp_replace(t, '[^0-9]+', '', 'g')) dig, length(t) n, list_transform(list_filter(w, lambda x: list_contains({known}, x)), lambda x: lower(x)) hits, {listed} own from d join ln using (doc_id) left join rw using (doc_id)),
 h as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, [low, up, dig, n_symbols, word_chars - low - up - dig - n_symbols, n - word_chars] ch, list_transform(own, lambda k: len(list_filter(hits, lambda x: x = k))) cm from c),
 i as (select * exclude (cm), cm || [n_words - list_sum(cm)::bigint] wd from h),
 j as (select *, {shares('ch')} cs, {shares('wd')} ws from i),
 r as (select lang, {means('cs', len(rules.CHAR_CLASSES))} rc, {means('ws', rules.N_COMMON + 1)} rs from j where not base_failed group by lang),
 k as (select j.*, case when word_chars >= {rules.MIN_CHARS} then {distance('cs', 'rc')} end cd, case when n_words >= {rules.MIN_WORDS} then {distance('ws', 'rs')} end wdist from j left join r using (lang))
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 6) char_distance, round(wdist, 6) word_distance, not base_failed and coalesce(cd, 0) <= {rules.MAX_CHAR_DISTANCE} and coalesce(wdist, 0) <= {rules.MAX_WORD_DISTANCE} kept from k"""


QUALITY_RULES = _quality()
