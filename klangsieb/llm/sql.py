"""SQL for DuckDB that must give the same rows as the queries of this folder."""

from __future__ import annotations

# The entities that occur in the tables; the operators resolve all there are.
ENTITIES = {
    "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&Auml;": "Ä", "&Ouml;": "Ö", "&Uuml;": "Ü", "&szlig;": "ß", "&#228;": "ä", "&#246;": "ö", "&#252;": "ü", "&#xDF;": "ß", "&#223;": "ß",
    "&#196;": "Ä", "&#214;": "Ö", "&#220;": "Ü", "&atilde;": "ã", "&ccedil;": "ç", "&eacute;": "é", "&raquo;": "»", "&laquo;": "«", "&nbsp;": " ",
}


def words(text: str) -> str:
    """The plain words of a column."""
    for entity, char in ENTITIES.items():
        text = f"replace({text}, '{entity}', '{char}')"
    clean = f"regexp_replace(nfc_normalize({text}), '[\\x{{ad}}\\x{{200b}}-\\x{{200d}}\\x{{feff}}]', '', 'g')"
    return f"regexp_extract_all(replace(lower({clean}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"


_SPLIT = "lower(trim(split))"
_CLIPS = """
clip as (select idx, arg_max({'c': lower(trim(corpus)), 'd': dur_proc_s}, written_at) as h from dataset_meta where idx is not null group by idx),
reg as (select name, arg_max(enabled, registered_at) as enabled from corpora group by name),
item as (select idx, h.c as source, case when h.d > 0 and not isnan(h.d) then h.d else 0 end as size from clip where h.c in (select lower(trim(name)) from reg where enabled))
"""
_PLAN = f"""{_CLIPS},
have as (select source, count(*) as n_items, sum(size::decimal(18,6)) as d from item group by source),
plan as (
  select name, lower(trim(name)) as source, target_share, max_repeat, coalesce(n_items, 0) as n_items, coalesce(d::double, 0) as available,
    target_share * (select coalesce(sum(d)::double, 0) from have) as target_size
  from mix_targets left join have on have.source = lower(trim(name))
),
wish as (
  select *, floor(case when available > 0 then least(max_repeat::double, target_size / available) else max_repeat::double end * 16777216.0 + 0.5)::bigint as expect,
    ('0x' || substr(sha1('mix:' || source), 1, 6))::bigint as offs from plan
),
run as (
  select item.idx, item.source, size, expect, offs, coalesce(sum(expect) over (partition by item.source order by size, sha1('mix:' || idx), idx rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from item join wish on wish.source = item.source
),
mix as (select idx, source, size, (((before + offs + expect) >> 24) - ((before + offs) >> 24))::int as copies from run),
got as (select source, sum(copies)::bigint as copies, sum(size::decimal(18,6) * copies)::double as reached from mix where copies > 0 group by source)
"""
_TERMS = f"""
rec as (select idx, arg_min({{'t': text}}, line_no).t as text from texts where idx is not null group by idx),
tok as (select idx, unnest({words("text")}) as term from rec),
cnt as (select term, count(*) as occurrences, count(distinct idx) as records from tok group by term),
marked as (select *, case when records < 3 then 'rare' when records * 10 > (select count(*) from rec) then 'common' end as mark from cnt)
"""
_SPEAKERS = r"""
held as (select idx, arg_max({'s': speaker}, line_no).s as raw from speakers where idx is not null group by idx),
keyed as (
  select idx, case when s <> '' then regexp_replace(s, '(^|[^0-9])0+([0-9]+)$', '\1\2') end as speaker
  from (select idx, regexp_replace(lower(regexp_replace(raw, '^\s+|\s+$', '', 'g')), '[\s_-]+', '-', 'g') as s from held)
)
"""
_CAPPED = f"""{_SPEAKERS},
q as (select idx, arg_max({{'s': snr}}, measured_at).s as snr from qualitaet where idx is not null group by idx),
ranked as (
  select idx, speaker, row_number() over (partition by speaker order by case when isnan(snr) then null else snr end desc nulls last, idx) as rank
  from keyed left join q using (idx) where speaker is not null
)
"""
_PAIRS = f"""
train as (select distinct idx from splits where {_SPLIT} = 'train'),
base as (select idx, {words("text")} as w from (select idx, arg_min({{'t': text}}, line_no).t as text from texts group by idx) where idx in (select idx from train)),
query as (select distinct id, {words("text")} as w from testset),
close as (
  select id, idx, query.w as a, base.w as b from query join base
    on abs(len(query.w) - len(base.w)) * 5 <= greatest(len(query.w), len(base.w)) and len(query.w) > 0 and len(base.w) > 0
    and (greatest(len(query.w), len(base.w)) - len(list_intersect(query.w, base.w))) <= 0.6 * greatest(len(query.w), len(base.w))
),
coded as (select id, idx, a, b, list_distinct(a || b) as d from close),
pairs as (
  select id, idx, levenshtein(array_to_string(list_transform(a, lambda x: chr(32 + list_position(d, x)::int)), ''), array_to_string(list_transform(b, lambda x: chr(32 + list_position(d, x)::int)), '')) as edits,
    greatest(len(a), len(b)) as n
  from coded where len(d) <= 94
)
"""
_LEAKS = f"""
p as (select item_id, {words("text")} as w from eval_passages),
grams as (select distinct item_id, array_to_string(w[k : k + 7], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 6)) as k from p)),
d as (select doc_id, {words("text")} as w from documents),
dgrams as (select doc_id, k, array_to_string(w[k : k + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as k from d)),
hit as (select doc_id, item_id, k from dgrams join grams using (g))
"""

SQL: dict[str, str] = {
    "p1_found": f"with {_PLAN} select name from plan where max_repeat * available < target_size",
    "p1_report": f"""with {_PLAN} select name, target_share, max_repeat, n_items, round(available, 3) as available, round(target_size, 3) as target_size, coalesce(copies, 0) as copies,
        round(coalesce(reached, 0), 3) as reached_size, round(coalesce(reached, 0) / (select sum(reached) from got), 6) as reached_share, max_repeat * available < target_size as limited
        from plan left join got using (source)""",
    "p1_mix": f"with {_PLAN} select idx, source as corpus, size as dur_proc_s, copies from mix where copies > 0",
    "p2_found": f"with {_TERMS} select term, mark from marked where mark is not null",
    "p2_terms": f"with {_TERMS} select term, occurrences, records, mark from marked",
    "p3_found": f"with {_CAPPED} select idx from ranked where rank > 25",
    "p3_clips": f"with {_CAPPED} select idx, speaker, rank, rank <= 25 as kept from ranked union all select idx, null, null, true from keyed where speaker is null",
    "p5_found": f"with {_SPEAKERS} select speaker from keyed join splits using (idx) where speaker is not null and {_SPLIT} in ('train', 'val', 'test') group by speaker having count(distinct {_SPLIT}) > 1",
    "p6_found": f"with {_PAIRS} select distinct id, idx from pairs where edits * 5 <= n",
    "p6_report": f"""with {_PAIRS}, near as (select id, idx, min(edits) as edits from pairs where edits * 5 <= n group by all),
        i as (select id, min(corpus) as item_corpus from testset group by id), c as (select idx, arg_min({{'c': corpus}}, line_no).c as clip_corpus from texts group by idx)
        select item_corpus, clip_corpus, 'train' as split, count(distinct id) as items, count(distinct idx) as clips, count(*) as pairs, count(*) filter (edits = 0) as same
        from near join i using (id) join c using (idx) group by all""",
    "p7_found": "select doc_id from documents where strlen(text) > 8192",
    "p8_found": f"with {_LEAKS} select distinct item_id, doc_id from hit",
    "p8_documents": f"with {_LEAKS} select doc_id, count(distinct item_id) as items, count(*) as runs, min(item_id) as first_item from hit group by doc_id",
    "p9_found": "select doc_id from documents where strlen(text) > 2048",
}
