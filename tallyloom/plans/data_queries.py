"""Queries of the general data-loading operators (drifting schemas, rows that fail to parse)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import drift, rejects
from tallyloom.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "run_files"), table(spark, d, "run_file_lines"))


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "run_files"), table(spark, d, "run_file_lines"))


def p4_statistics(spark: SparkSession, d: str) -> DataFrame:
    return drift.statistics(table(spark, d, "run_file_lines"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.failures(table(spark, d, "raw_records"))


def p5_items(spark: SparkSession, d: str) -> DataFrame:
    items = rejects.clean(table(spark, d, "raw_records"))[0]
    return items.select("raw_id", "question_number", "stem", *[F.col("choices")[x].alias(f"choice_{x.lower()}") for x in "ABCD"])


def p5_keys(spark: SparkSession, d: str) -> DataFrame:
    return rejects.clean(table(spark, d, "raw_records"))[1]


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return rejects.report(table(spark, d, "raw_records"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p4_found, p4_unified, p4_statistics, p5_found, p5_items, p5_keys, p5_report)
}

# Both dialects of a record as plain regular expressions, without the possessive forms of the operator.
_PARSED = r"""
  body as (
    select raw_id, file_name, feed, case when feed = 'answers' then regexp_replace(raw_text, '(?s)#.*', '') else coalesce(raw_text, '') end as b from raw_records),
  kept as (select * from body where feed = 'mcq' or (feed = 'answers' and not regexp_full_match(coalesce(b, ''), '\s*'))),
  parsed as (
    select *,
      case when feed = 'mcq' then regexp_full_match(b, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*')
           else regexp_full_match(b, '[ \t]*(("[^"]*"|[^" \t]+)([ \t]+|$))*') end as quoted,
      case when feed = 'mcq' then regexp_extract_all(b || ',', '(?s)("([^"]|"")*"|[^",]*),', 1) else regexp_extract_all(b, '"[^"]*"|[^" \t]+') end as c
    from kept),
  valued as (
    select *, [trim(case when length(x) >= 2 and x[1] = '"' and x[-1] = '"' then replace(x[2:-2], '""', '"') else x end, E' \t\r\n') for x in c] as v from parsed),
  ranked as (
    select *, case when not quoted then 'quoting' when len(c) <> case feed when 'mcq' then 6 else 2 end then 'column_count'
      when feed = 'mcq' and (not regexp_full_match(v[1], '0*[1-9][0-9]*') or len([x for x in v[2:] if regexp_full_match(x, '\s*')]) > 0) then 'bad_value'
      when feed = 'answers' and (not regexp_full_match(v[1], '0*[1-9][0-9]*[.)]?') or not regexp_full_match(v[2], '[A-Da-d?]')) then 'bad_value' end as failure
    from valued)
"""

_W = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_FILES = rf"""
  split as (
    select file_id, line_no, [case when length(x) >= 2 and x[1] = '"' and x[-1] = '"' then replace(x[2:-2], '""', '"') else x end
      for x in regexp_extract_all(regexp_replace(line, '^\x{{FEFF}}', '') || ',', '(?s)("[^"]*(?:""[^"]*)*"[^,]*|[^,]*),', 1)] as f from run_file_lines where line is not null),
  heads as (select file_id, [lower(regexp_replace(x, '({_W}|\x{{FEFF}})+', '', 'g')) for x in f] as names from (select file_id, arg_min(f, line) as f from (
    select s.file_id, s.f, l.line from split s join run_file_lines l using (file_id, line_no) where line_no = 0) group by file_id)),
  cells as (
    select file_id, line_no, i as place, names[i + 1] as name, regexp_replace(regexp_replace(f[i + 1], '^{_W}+', ''), '{_W}+$', '') as value
    from (select s.file_id, line_no, f, names, unnest(range(0, least(len(f), len(names)))) as i from split s join heads h on s.file_id = h.file_id where line_no > 0)),
  kinds as (
    select file_id, place, case when bool_and(regexp_full_match(value, '[+-]?[0-9]+')) then 'whole' when bool_and(regexp_full_match(value, '[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?')) then 'number'
      when bool_and(regexp_full_match(lower(value), 'true|false')) then 'truth' else 'text' end as kind from cells where value <> '' group by file_id, place),
  placed as (select file_id, names[i + 1] as name, i as place from (select file_id, names, unnest(range(0, len(names))) as i from heads)),
  col as (select c.file_id, c.name, c.place, k.kind from (select file_id, name, min(place) as place from placed group by all) c left join kinds k using (file_id, place)),
  ordered as (select file_id, lag(file_id) over (partition by feed_id order by written_at, file_id) as old_id from run_files where file_id in (select file_id from heads)),
  gone as (select o.file_id, c.name, c.place, c.kind from ordered o join col c on c.file_id = o.old_id where not exists (select 1 from col n where n.file_id = o.file_id and n.name = c.name)),
  come as (select o.file_id, c.name, c.place, c.kind from ordered o join col c on c.file_id = o.file_id where o.old_id is not null and not exists (select 1 from col n where n.file_id = o.old_id and n.name = c.name)),
  renamed as (select g.file_id, g.name as old_name, c.name as new_name, g.kind as old_kind, c.kind as new_kind, g.place from gone g join come c on c.file_id = g.file_id and c.place = g.place),
  kept as (select o.file_id, a.name as old_name, b.name as new_name, a.kind as old_kind, b.kind as new_kind from ordered o join col a on a.file_id = o.old_id join col b on b.file_id = o.file_id and b.name = a.name)
"""

ORACLE: dict[str, str] = {
    "p4_found": f"""with {_FILES}
      select file_id, 'renamed' as change_kind, old_name, new_name from renamed
      union all select file_id, 'removed', name, '' from gone g where not exists (select 1 from renamed r where r.file_id = g.file_id and r.place = g.place)
      union all select file_id, 'added', '', name from come c where not exists (select 1 from renamed r where r.file_id = c.file_id and r.place = c.place)
      union all select file_id, 'retyped', old_name, new_name from (select file_id, old_name, new_name, old_kind, new_kind from renamed union all select * from kept) where old_kind <> new_kind""",
    "p4_statistics": f"""with {_FILES}
      select file_id, name, count(value) as n_values, count(*) filter (value = '') as n_blank, count(*) filter (regexp_full_match(value, '[+-]?[0-9]+')) as n_whole,
        count(*) filter (regexp_full_match(value, '[+-]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?')) as n_number, count(*) filter (regexp_full_match(lower(value), 'true|false')) as n_truth from cells group by file_id, name""",
    "p5_items": f"""with {_PARSED} select raw_id, try_cast(regexp_replace(v[1], '[.)]$', '') as bigint) as question_number, v[2] as stem, v[3] as choice_a, v[4] as choice_b, v[5] as choice_c, v[6] as choice_d
      from ranked where failure is null and feed = 'mcq'""",
    "p5_found": f"with {_PARSED} select raw_id, failure from ranked where failure is not null",
    "p5_report": f"with {_PARSED} select file_name, feed, failure, count(*) as n_rows from ranked where failure is not null group by all",
    "p5_keys": f"""with {_PARSED} select raw_id, try_cast(regexp_replace(v[1], '[.)]$', '') as bigint) as question_number, nullif(upper(v[2]), '?') as gold
      from ranked where failure is null and feed = 'answers'""",
}
