"""Queries over raw input lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from klangsieb.operators.malformed import accepted, load_lines, rejects
from klangsieb.plans.catalog import query, table

# html entities that the lines use for white space
_CLEAN = r"""
lines as (
  select line_id, file_kind, regexp_replace(regexp_replace(regexp_replace(line, '^\x{feff}', ''), '^[ \r]+', ''), '[ \r]+$', '') as l from texts_raw
),
kept as (
  select *, case when file_kind = 'listing' and instr(l, '==') > 0 then substr(l, 1, instr(l, '==') - 1) end as lp,
    case when file_kind = 'listing' and instr(l, '==') > 0 then substr(l, instr(l, '==') + 2) end as lt,
    case when file_kind = 'pipe' then regexp_full_match(l, '("([^"]|"")*"|[^"|][^|]*|)([|]("([^"]|"")*"|[^"|][^|]*|))*', 's') end as quoted_well,
    case when file_kind = 'pipe' then regexp_extract_all('|' || l, '(?s)[|]("(?:[^"]|"")*"|[^"|][^|]*|)', 1) when file_kind = 'tsv' then string_split(l, chr(9)) end as raw
  from lines where regexp_matches(l, '[^\s\x{a0}\x{2000}-\x{200a}\x{3000}\x{85}\x{1c}-\x{1f}]')
),
fields as (
  select *, case when file_kind = 'pipe' then list_transform(raw, lambda x: case when x[1] = '"' then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) else raw end as f,
  from kept
),
shown as (
  select *, list_transform(case when file_kind = 'listing' then [lt] else f end, lambda x: not regexp_matches(regexp_replace(x, '&nbsp;|&#160;|&#xA0;|&#xa0;', ' ', 'g'), '[^\s\x{a0}\x{2000}-\x{200a}\x{3000}\x{85}\x{1c}-\x{1f}]')) as empty,
    regexp_matches(l, '[\x{00}-\x{08}\x{0a}-\x{1f}\x{fffd}]') as odd
  from fields
),
judged as (
  select line_id, file_kind, case
    when file_kind = 'listing' then case when lp is null then 'columns' when not regexp_full_match(lp, 'wavs/[^\s\x{a0}]+\.wav') or empty[1] or odd then 'value' end
    when file_kind = 'pipe' then case when not quoted_well then 'quoting' when len(f) <> 5 then 'columns'
      when empty[1] or empty[3] or empty[4] or odd or not regexp_full_match(f[2], '[0-9]+([.][0-9]+)?') or not coalesce(try_cast(f[2] as double) > 0, false)
        or not (f[5] = '' or (regexp_full_match(f[5], '[0-9]+([.][0-9]+)?') and try_cast(f[5] as double) <= 1)) then 'value' end
    else case when len(f) <> 5 then 'columns' when empty[1] or empty[2] or empty[3] or odd or not regexp_full_match(f[4], '[0-9]+') or not regexp_full_match(f[5], '[0-9]+') then 'value' end end as reason,
    lp, lt, f
  from shown
)
"""


@query("p4_found", f"with {_CLEAN} select line_id, reason from judged where reason is not null")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects(load_lines(table(spark, folder, "texts_raw"))).select("line_id", "reason").distinct()


@query(
    "p4_rows",
    f"""with {_CLEAN} select line_id, file_kind,
      case file_kind when 'listing' then lp when 'pipe' then f[1] else f[2] end as wav_rel,
      case file_kind when 'listing' then lt else f[3] end as text,
      case when file_kind = 'pipe' then try_cast(f[2] as double) end as duration,
      case file_kind when 'pipe' then f[4] when 'tsv' then f[1] end as client_id,
      case when file_kind = 'pipe' and f[5] <> '' then try_cast(f[5] as double) end as levenshtein,
      case when file_kind = 'tsv' then try_cast(f[4] as bigint) end as up_votes, case when file_kind = 'tsv' then try_cast(f[5] as bigint) end as down_votes
    from judged where reason is null""",
)
def p4_rows(spark: SparkSession, folder: str) -> DataFrame:
    return accepted(load_lines(table(spark, folder, "texts_raw")))
