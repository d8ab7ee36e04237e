"""Queries of problem 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import schema_drift as sd
from ..sources.tables import table

COLUMNS = ["file_name", "site", "table_name", "exported_at", "line_no", "record"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "journal_lines", COLUMNS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sd.drift_report(_lines(spark, d)).select("site", "table_name", "file_name", "field", "change")


def p1_union_schema(spark: SparkSession, d: str) -> DataFrame:
    drift = sd.Drift(_lines(spark, d))
    return sd.union_schema(drift, sd.canonical_names(drift))


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every valid record in the union schema of its table, as JSON."""
    lines = _lines(spark, d)
    columns = sd.unified_columns(sd.Drift(lines))
    parts = []
    for name, of_table in sorted(columns.items()):
        rows = sd.unified_table(lines, name, of_table)
        parts.append(rows.select("site", F.lit(name).alias("table_name"), "file_name", "line_no", F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns[4:]))).alias("record")))
    empty = lines.select("site", "table_name", "file_name", "line_no", "record").where("false")
    return reduce(DataFrame.unionByName, parts, empty)


def _unified(spark: SparkSession, d: str, name: str, wanted: list[str]) -> DataFrame:
    lines = _lines(spark, d)
    columns = sd.unified_columns(sd.Drift(lines)).get(name, [])
    return sd.unified_table(lines, name, [c for c in columns if c[0] in wanted]).select("site", "file_name", "line_no", *wanted)


def p1_feedback(spark: SparkSession, d: str) -> DataFrame:
    """The feedback of all files in one table."""
    return _unified(spark, d, "feedback", ["id", "check_id", "aspect_id", "aspect_name", "note_type", "verdict_status", "rating", "note"])


def p1_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The verdicts of all files in one table."""
    return _unified(spark, d, "verdicts", ["id", "check_id", "aspect_id", "status", "applicable", "n_citations", "downgraded"])


QUERIES = {"p1_found": p1_found, "p1_union_schema": p1_union_schema, "p1_unified": p1_unified, "p1_feedback": p1_feedback, "p1_verdicts": p1_verdicts}
#: The names of each column as a person groups them in the exported files; the queries find them by content.
_NAMES = {
    "id": "id Id row_id rowid",
    "check_id": "check_id checkId Check_ID check_ref chk parent_check run_id",
    "aspect_id": "aspect_id aspectId Aspect_Id aspect_no",
    "aspect_name": "aspect_name aspectName Aspect_Name aspect_title aspect_label title_of_aspect aspect",
    "note_type": "note_type noteType Note_Type note_kind type_of_note target decision",
    "verdict_status": "verdict_status verdictStatus status_of_verdict",
    "rating": "rating user_rating thumb",
    "note": "note note_text comment",
    "ts": "ts created",
    "status": "status Status outcome",
    "applicable": "applicable is_applicable applies",
    "n_citations": "n_citations nCitations citations",
    "downgraded": "downgraded is_downgraded lowered",
    "votes": "votes ballots vote_list",
}
_WHOLE = {"id", "check_id", "aspect_id", "applicable", "n_citations", "downgraded"}
_OPEN = "case when starts_with({0}, '[') and json_valid({0}) and json_array_length({0}) = 1 then {0}->>'$[0]' when starts_with({0}, '{{') and json_valid({0}) then coalesce({0}->>'$.id', {0}->>'$.code', {0}->>'$.label', {0}->>'$.value', {0}->>'$.name', {0}->>'$.text', {0}->>'$.ru') else {0} end"
_BARE = r"case when lower({0}) in ('true', 'yes') then '1' when lower({0}) in ('false', 'no') then '0' else regexp_replace(regexp_replace(lower(trim({0})), '^[a-z]{{1,5}}[-_#:]0*([0-9]+)$', '\1'), '\.0+$', '') end"


def _table_sql(name: str, wanted: list[str]) -> str:
    raw = ", ".join("coalesce(" + ", ".join(f"record->>'$.{n}'" for n in _NAMES[w].split()) + f") as {w}" for w in wanted)
    opened = ", ".join(f"{_OPEN.format(w)} as {w}" for w in wanted)
    out = ", ".join(f"try_cast({_BARE.format(w)} as bigint) as {w}" if w in _WHOLE else w for w in wanted)
    rows = f"select site, file_name, line_no, record from journal_lines where table_name = '{name}' and json_valid(record) and json_type(record) = 'OBJECT'"
    return f"with r as ({rows}), a as (select site, file_name, line_no, {raw} from r), b as (select site, file_name, line_no, {opened} from a) select site, file_name, line_no, {out} from b"


_COLUMN = ", ".join(f"('{n}', '{column}')" for column, names in _NAMES.items() for n in names.split())
SQL: dict[str, str] = {
    "p1_feedback": _table_sql("feedback", ["id", "check_id", "aspect_id", "aspect_name", "note_type", "verdict_status", "rating", "note"]),
    "p1_verdicts": _table_sql("verdicts", ["id", "check_id", "aspect_id", "status", "applicable", "n_citations", "downgraded"]),
    "p1_union_schema": f"""
with m(field, name) as (values {_COLUMN}),
r as (select site, table_name, file_name, record from journal_lines where json_valid(record) and json_type(record) = 'OBJECT'),
f as (select site, table_name, file_name, record, unnest(json_keys(record)) as field from r),
v as (select site, table_name, file_name, coalesce(m.name, field) as name, json_type(record, '$."' || field || '"') as t, record->>('$."' || field || '"') as x from f left join m using (field)),
o as (select *, case when t in ('UBIGINT', 'BIGINT') then 'whole' when t = 'DOUBLE' then 'decimal' when t = 'BOOLEAN' then 'boolean' when t = 'VARCHAR' then 'string' when t in ('ARRAY', 'OBJECT') then lower(t) end as seen, case when t in ('ARRAY', 'OBJECT') then {_OPEN.format("x")} else x end as y from v),
k as (select *, case when seen is null then null when seen = 'boolean' then 'boolean' when regexp_full_match(y, '-?[0-9]+([.]0+)?') then case when seen in ('whole', 'decimal') then 'whole' else 'digits' end
  when regexp_full_match(y, '-?[0-9]+[.][0-9]+') then case when seen = 'decimal' then 'decimal' else 'fraction' end when regexp_full_match(lower(y), '[a-z]{{1,5}}[-_#:][0-9]+') then 'coded' when lower(y) in ('true', 'false', 'yes', 'no') then 'flag' else 'string' end as kind from o)
select table_name, name as "column", case when string_agg(distinct seen, '+') = 'array' then 'array' when bool_or(kind = 'string') or not coalesce(bool_or(kind in ('boolean', 'whole', 'decimal')), false) then 'string'
 when bool_or(kind in ('decimal', 'fraction')) then 'decimal' when bool_or(kind in ('whole', 'digits', 'coded')) then 'whole' else 'boolean' end as union_type,
 coalesce(string_agg(distinct seen, '+' order by seen), '') as seen_types, count(distinct site || chr(31) || file_name) as n_files from k group by 1, 2""",
}
