"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import orphan_references, orphans_by_period
from ..sources.tables import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    children = [
        (name, table(spark, d, name).select(F.col("id").alias("row_id"), F.col("check_id").alias("ref_key"), F.col("loaded_at").alias("seen_at")))
        for name in ("verdicts", "feedback")
    ]
    parents = table(spark, d, "checks").select(F.col("id").alias("ref_key"), F.col("loaded_at").alias("seen_at"))
    deleted = table(spark, d, "deleted_checks").select(F.col("check_id").alias("ref_key"))
    return orphan_references(children, parents, deleted)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "row_id", "reason", "period")


def p3_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans_by_period(_orphans(spark, d))


_ROWS = """
with rows_ as (
  select 'verdicts' as table_name, id as row_id, check_id, min(loaded_at) as seen_at from verdicts where check_id is not null group by id, check_id
  union all
  select 'feedback', id, check_id, min(loaded_at) from feedback where check_id is not null group by id, check_id
), parents as (select id, min(loaded_at) as at from checks group by id),
found as (
  select table_name, row_id, r.check_id,
    case when p.id is not null then 'late' when exists (select 1 from deleted_checks d where d.check_id = r.check_id) then 'deleted' else 'missing' end as reason,
    strftime(seen_at, '%Y-%m') as period
  from rows_ r left join parents p on p.id = r.check_id
  where p.id is null or seen_at < p.at
)
"""

QUERIES = {"p3_found": p3_found, "p3_by_period": p3_by_period}
SQL = {
    "p3_found": _ROWS + "select table_name, row_id, reason, period from found",
    "p3_by_period": _ROWS + "select table_name, reason, period, count(*) as n_rows, count(distinct check_id) as n_keys from found group by all",
}
