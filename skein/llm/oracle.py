"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

MIXING = f"""
with rows as (
  select doc_id, source, cast(len({WORDS}) as bigint) as size, md5(coalesce(text, '')) as tie, md5(coalesce(cast(doc_id as varchar), 'null')) as mark
  from documents),
sizes as (select source, sum(size) as source_size from rows group by source),
ranked as (select *, row_number() over (order by source asc nulls last) as rank from sizes),
weighed as (select *, [5.0, 2.0, 1.0][(rank - 1) % 3 + 1]::double as w, [-0.5, 0.0, 0.5][(rank - 1) % 3 + 1]::double as slope, 3.0::double * source_size as cap from ranked),
left_over as (
  select *,
    (sum(source_size) over () - coalesce(sum(cap) over before, 0))::double / (sum(w) over () - coalesce(sum(w) over before, 0)) as level
  from weighed window before as (order by cap / w, rank rows between unbounded preceding and 1 preceding)),
chosen as (select level from left_over where level * w <= cap order by cap / w, rank limit 1),
targets as (select l.source, l.source_size, l.slope, least(cap, (select level from chosen) * w) as target from left_over l),
laid as (
  select r.*, t.source_size, t.slope, t.target,
    coalesce(sum(size) over (partition by r.source order by mark, tie rows between unbounded preceding and 1 preceding), 0) as start
  from rows r join targets t on r.source is not distinct from t.source),
placed as (
  select *, (case when size > 0 then [x for x in [start + size / 2.0, source_size + start + size / 2.0, 2 * source_size + start + size / 2.0] if x < target] else [] end) as spots
  from laid)
select doc_id, size, cast(source_size as bigint) as source_size, target, cast(size * len(spots) as bigint) as taken,
  case when len(spots) = 0 then null
       when slope = 0 then round(spots[1] / target, 9)
       else round(((1 + slope) - sqrt(greatest(0.0, (1 + slope) * (1 + slope) - 4 * slope * (spots[1] / target)))) / (2 * slope), 9) end as position
from placed
"""

ODD_WORD = r"[#*$%&|<>]|[!?]{2}$"
STOCK = "|".join([
    "all rights reserved", "cookie policy", "enable javascript", "privacy policy",
    "alle rechte vorbehalten", "cookie-richtlinie", "javascript aktivieren", "datenschutzerklärung",
    "tous droits réservés", "politique de cookies", "activer javascript", "politique de confidentialité",
    "todos los derechos reservados", "política de cookies", "habilite javascript", "política de privacidad",
])

QUALITY = rf"""
with a as (select doc_id, coalesce(text, '') as t, {WORDS} as ws from documents),
b as (
  select *, len(ws) as n,
    list_transform(range(1, greatest(len(ws) - 3, 1)), lambda i: array_to_string(ws[i:i+4], ' ')) as win,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from a),
c as (select doc_id, i, v from (select doc_id, unnest(range(1, len(win) + 1)) as i, unnest(win) as v from b)),
d as (select doc_id, i, count(*) over (partition by doc_id, v) as k from c),
e as (select doc_id, i, least(5, coalesce(lead(i) over (partition by doc_id order by i) - i, 5)) as step from d where k > 1),
f as (select doc_id, sum(step) as repeated from e group by doc_id),
g as (select b.*, cast(coalesce(f.repeated, 0) as bigint) as repeated from b left join f using (doc_id)),
h as (
  select *, n < 10 or 100 * repeated > 20 * n as failed,
    list_filter(lines, lambda x: not (
      len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: regexp_matches(w, '{ODD_WORD}')))
        > 0.3 * len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> ''))
      or (length(x) - length(replace(x, '|', '')) >= 3
        and 4 * (length(x) - length(replace(x, '|', ''))) >= len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')))
      or regexp_matches(lower(x), '{STOCK}')
      or (repeated > 0 and len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) >= 10
        and len(list_distinct(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')))
          <= 0.2 * len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> ''))))) as good
  from g),
i as (
  select *, case when len(good) = len(lines) then n
    else len(list_filter(string_split_regex(array_to_string(good, chr(10)), '[\x20\x09-\x0D]+'), lambda w: w <> '')) end as kept_n
  from h)
select doc_id, cast(n as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, repeated as n_repeat_words,
  failed as base_failed, not failed and kept_n >= 0.5 * n as kept, cast(kept_n as bigint) as kept_words
from i
"""

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DIVERGENCE = rf"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}') as t from documents),
g as (select distinct lang, source from d),
w as (select id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as everywhere from w group by lang, term having count(distinct id) >= 30),
v as (select lang, count(*) as v, sum(everywhere) as n_lang from k group by lang),
c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by lang, source, term),
n as (select g.lang, g.source, cast(coalesce(sum(c.n), 0) as hugeint) as total from g left join c using (lang, source) group by g.lang, g.source),
p as (
  select n.lang, n.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (n.total + 5 * v.v) as p,
    1 + (1000000000::hugeint * (k.everywhere + 5)) // (cast(v.n_lang as hugeint) + 5 * v.v) as q
  from n join k on k.lang = n.lang join v on v.lang = n.lang left join c on c.lang = n.lang and c.source = n.source and c.term = k.term),
far as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(far.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join far on far.lang = a.lang and far.source = a.source and far.item = b.source),
both_ as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', term, p - q from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from both_)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 50
"""

INFILL = r"""
with a as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), 'null')) as h from documents),
b as (select *, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from a),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as x, greatest(h1 % (n + 1), h2 % (n + 1)) as y,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from b),
d as (select *, array_slice(t, 1, x) as p, array_slice(t, x + 1, y) as m, array_slice(t, y + 1, n) as s from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(x as bigint) end as prefix_chars, case when form <> 'plain' then cast(y - x as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256 from d
"""

ORACLES = {"op6_quality": QUALITY, "op9_mixing": MIXING, "op11_divergence": DIVERGENCE, "op12_infill": INFILL}
