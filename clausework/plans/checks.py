"""Queries of validation, lookups and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import boxes as B
from ..sources.tables import table

c = F.col


def p14_scraps(spark: SparkSession, d: str) -> DataFrame:
    """Chunks kept and dropped as scraps, by document: one with a clause, an appendix or 120 characters is kept."""
    chunks = table(spark, d, "chunks", ["chunk_id", "clause", "appendix", "text"]).distinct()
    kept = c("clause").isNotNull() | c("appendix").isNotNull() | (F.length("text") >= 120)
    return chunks.groupBy(F.regexp_extract("chunk_id", "^(.*):", 1).alias("document")).agg(F.count("*").alias("n"), F.count_if(kept).alias("kept"), F.count_if(F.coalesce(~kept, F.lit(True))).alias("scraps"))


def a30_code_alphabet(spark: SparkSession, d: str) -> DataFrame:
    """Regions with additive codes whose letter is Cyrillic, the codes distinct and sorted."""
    codes = F.array_distinct(F.regexp_extract_all("text", F.lit("Е[0-9]{3}"), F.lit(0)))
    return table(spark, d, "regions", ["region_key", "text"]).select("region_key", F.array_join(F.array_sort(codes), "|").alias("codes")).where("codes <> ''")


def j05_top_two(spark: SparkSession, d: str) -> DataFrame:
    """Of each additive code the first two chunks of each regulation that name it."""
    rows = table(spark, d, "chunks", ["chunk_id", "regulation_id", "text"]).distinct()
    found = rows.select("regulation_id", "chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[EЕ]([0-9]{3})"), F.lit(1)))).alias("code"))
    place = F.row_number().over(Window.partitionBy("regulation_id", "code").orderBy("chunk_id"))
    return found.withColumn("place", place).where("place <= 2")


def j14_uncovered(spark: SparkSession, d: str) -> DataFrame:
    """Regions of later reads whose centre no region of the first read covers."""
    boxes = table(spark, d, "regions", ["source_sha256", "read_no", "region_key", "x0", "y0", "x1", "y1"]).dropna(subset=B.CORNERS)
    first = boxes.where("read_no = 1").withColumnRenamed("region_key", "outer_id").drop("read_no")
    later = boxes.where("read_no > 1").withColumnRenamed("region_key", "inner_id").drop("read_no")
    covered = B.centre_join(first, later, ["source_sha256"]).select("inner_id").distinct()
    return later.join(covered, "inner_id", "left_anti").select("source_sha256", "inner_id")


def f16_clause_references(spark: SparkSession, d: str) -> DataFrame:
    """Clauses that a chunk's text names and its document does not have."""
    chunks = table(spark, d, "chunks", ["chunk_id", "regulation_id", "clause", "text"]).distinct()
    named = chunks.select("chunk_id", "regulation_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("пункт[а-я]* ([0-9]+)"), F.lit(1)))).alias("clause"))
    have = chunks.select("regulation_id", "clause").where("clause is not null").distinct()
    return named.join(have, ["regulation_id", "clause"], "left_anti").select("chunk_id", "clause")


def f26_grid(spark: SparkSession, d: str) -> DataFrame:
    """The tiles of a grid of tenths that the regions of each layout's first read touch, with their number of regions."""
    boxes = table(spark, d, "regions", ["source_sha256", "read_no", "region_key", "x0", "y0", "x1", "y1"]).dropna(subset=B.CORNERS).where("read_no = 1")
    return B.cells(boxes, 0.1).groupBy("source_sha256", "cx", "cy").agg(F.count_distinct("region_key").alias("n"))


def c01_validate(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts after the deterministic tests: an unknown status or a compliant one without a citation is manual."""
    verdicts = table(spark, d, "verdicts", ["id", "status", "applicable", "n_citations"]).distinct()
    reason = F.when(~F.coalesce(c("status"), F.lit("")).isin("ok", "manual", "violation"), "status").when((c("applicable") == 1) & (c("status") != "manual") & (F.coalesce("n_citations", F.lit(0)) == 0), "citation")
    checked = verdicts.select("id", "status", reason.alias("reason"))
    return checked.select("id", F.when(c("reason").isNotNull(), "manual").otherwise(c("status")).alias("status"), "reason")


def j31_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of several kinds in one long table, counted by kind."""
    a = a30_code_alphabet(spark, d).select(F.lit("alphabet").alias("kind"), c("region_key").cast("string").alias("of"))
    b = j14_uncovered(spark, d).select(F.lit("uncovered").alias("kind"), c("inner_id").cast("string").alias("of"))
    e = f16_clause_references(spark, d).select(F.lit("reference").alias("kind"), c("chunk_id").alias("of"))
    return a.unionByName(b).unionByName(e).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("of").alias("n_of"))


QUERIES = {f.__name__: f for f in (p14_scraps, a30_code_alphabet, j05_top_two, j14_uncovered, f16_clause_references, f26_grid, c01_validate, j31_findings)}
_CH = "(select distinct chunk_id, regulation_id, clause, appendix, text from chunks)"
_BOX = "(select * from regions where x0 is not null and y0 is not null and x1 is not null and y1 is not null)"
SQL = {
    "p14_scraps": f"select regexp_extract(chunk_id, '^(.*):', 1) as document, count(*) as n, count(*) filter (where clause is not null or appendix is not null or length(text) >= 120) as kept, count(*) filter (where not coalesce(clause is not null or appendix is not null or length(text) >= 120, false)) as scraps from {_CH} group by 1",
    "a30_code_alphabet": "select * from (select region_key, array_to_string(list_sort(list_distinct(regexp_extract_all(text, 'Е[0-9]{3}'))), '|') as codes from regions) where codes <> ''",
    "j05_top_two": f"with f as (select distinct regulation_id, chunk_id, unnest(regexp_extract_all(text, '[EЕ]([0-9]{{3}})', 1)) as code from {_CH}) select regulation_id, chunk_id, code, row_number() over (partition by regulation_id, code order by chunk_id)::int as place from f qualify place <= 2",
    "j14_uncovered": f"select source_sha256, region_key as inner_id from {_BOX} b where read_no > 1 and not exists (select 1 from {_BOX} a where a.read_no = 1 and a.source_sha256 = b.source_sha256 and (b.x0 + b.x1) / 2 between a.x0 and a.x1 and (b.y0 + b.y1) / 2 between a.y0 and a.y1)",
    "f16_clause_references": f"with n as (select distinct chunk_id, regulation_id, unnest(regexp_extract_all(lower(text), 'пункт[а-я]* ([0-9]+)', 1)) as clause from {_CH}) select chunk_id, n.clause from n where not exists (select 1 from chunks k where k.regulation_id = n.regulation_id and k.clause = n.clause)",
    "f26_grid": f"with x as (select *, unnest(range(floor(x0 / 0.1)::int, floor(x1 / 0.1)::int + 1)) as cx from {_BOX} where read_no = 1), y as (select *, unnest(range(floor(y0 / 0.1)::int, floor(y1 / 0.1)::int + 1)) as cy from x) select source_sha256, cx::int as cx, cy::int as cy, count(distinct region_key) as n from y group by 1, 2, 3",
    "c01_validate": "select distinct id, case when reason is not null then 'manual' else status end as status, reason from (select *, case when coalesce(status, '') not in ('ok','manual','violation') then 'status' when applicable = 1 and status <> 'manual' and coalesce(n_citations, 0) = 0 then 'citation' end as reason from (select distinct id, status, applicable, n_citations from verdicts))",
}
SQL["j31_findings"] = f"with a as ({SQL['a30_code_alphabet']}), b as ({SQL['j14_uncovered']}), e as ({SQL['f16_clause_references']}) select kind, count(*) as n, count(distinct o) as n_of from (select 'alphabet' as kind, region_key::varchar as o from a union all select 'uncovered', inner_id::varchar from b union all select 'reference', chunk_id from e) group by 1"
