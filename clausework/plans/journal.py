"""Queries over the journal of checks, verdicts and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import journal as J
from ..sources.tables import table

c = F.col


def _once(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table with repeated deliveries counted once, the earliest."""
    rows = table(spark, d, name)
    rest = [x for x in rows.columns if x not in ("id", "loaded_at")]
    return rows.groupBy("id").agg(F.min_by(F.struct(*rest), "loaded_at").alias("row"), F.min("loaded_at").alias("loaded_at")).select("id", *(c("row")[x].alias(x) for x in rest), "loaded_at")


def s14_append_ids(spark: SparkSession, d: str) -> DataFrame:
    """Feedback without a check, appended to the journal with new ids in order of time."""
    feedback = table(spark, d, "feedback", ["id", "check_id", "ts"])
    new = feedback.where("check_id is null").select(c("id").alias("old_id"), "ts").distinct()
    return J.with_new_ids(feedback, new, "id", ["ts", "old_id"]).select("id", "old_id")


def s15_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """One feedback row for each check and aspect: the latest content under the first id."""
    rows = table(spark, d, "feedback", ["id", "check_id", "aspect_id", "rating", "note", "ts", "loaded_at"]).where("check_id is not null").withColumn("order_id", c("id"))
    old, new = rows.where("loaded_at < timestamp'2024-07-01'"), rows.where("loaded_at >= timestamp'2024-07-01'")
    return J.upsert(old, new, ["check_id", "aspect_id"], "id", ["ts", "order_id", "loaded_at"]).select("id", "check_id", "aspect_id", "rating", "note", "ts")


def s16_desc_limit(spark: SparkSession, d: str) -> DataFrame:
    """The fifty last checks."""
    return table(spark, d, "checks", ["id", "ts", "category_scan"]).distinct().orderBy(F.desc("id")).limit(50)


def s17_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Checks without verdicts, and whether a report file of the name is known from another check."""
    checks = table(spark, d, "checks", ["id", "report_path"]).distinct()
    bare = J.missing_children(checks, "id", table(spark, d, "verdicts", ["check_id"]).where("check_id is not null"), "check_id")
    files = checks.where("report_path is not null").groupBy(T.file_name(c("report_path")).alias("file_name")).agg(F.count_distinct("report_path").alias("n_paths"))
    return bare.withColumn("file_name", T.file_name(c("report_path"))).join(files, "file_name", "left").select("id", "file_name", F.coalesce("n_paths", F.lit(0)).alias("n_paths"))


def s26_pick_source(spark: SparkSession, d: str) -> DataFrame:
    """The newest month that has feedback wins; each month's rows."""
    rows = table(spark, d, "feedback", ["id", "loaded_at"]).groupBy(F.date_format("loaded_at", "yyyy-MM").alias("month")).agg(F.count_distinct("id").alias("n"))
    return rows.join(rows.agg(F.max("month").alias("month")).withColumn("picked", F.lit(True)), "month", "left").select("month", "n", F.coalesce("picked", F.lit(False)).alias("picked"))


def a07_check_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by status of each check, against the counts that the check carries."""
    verdicts = _once(spark, d, "verdicts").where("check_id is not null")
    counted = verdicts.groupBy("check_id").agg(*J.status_counts(c("status"), c("applicable") == 1))
    checks = _once(spark, d, "checks").select("id", c("n_violation").alias("said"))
    joined = checks.join(counted, checks["id"] == counted["check_id"], "left")
    return joined.select("id", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("n_violation", "n_manual", "n_ok", "n_na")), c("said").cast("bigint").alias("said"))


def a09_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last check of each layout; without a hash its file name stands for it."""
    return table(spark, d, "checks", ["id", "source_sha256", "source_pdf"]).groupBy(F.coalesce("source_sha256", "source_pdf").alias("layout")).agg(F.max("id").alias("id"))


def a08_status_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Statuses of each aspect over the last check of each layout, with the share of problems."""
    latest = a09_latest(spark, d).select(c("id").alias("check_id"))
    verdicts = table(spark, d, "verdicts", ["id", "check_id", "aspect_id", "status", "applicable"]).distinct()
    rows = verdicts.join(latest, "check_id", "left_semi").groupBy("aspect_id").agg(*J.status_counts(c("status"), c("applicable") == 1))
    applicable = c("n_violation") + c("n_manual") + c("n_ok")
    names = table(spark, d, "aspects", ["aspect_id", "aspect_name"])
    return rows.join(names, "aspect_id", "left").select("aspect_id", "aspect_name", "n_violation", "n_manual", "n_ok", "n_na", F.coalesce(J.share(c("n_violation") + c("n_manual"), applicable), F.lit(0.0)).alias("problem_share"))


def a10_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Ratings of each aspect; agreement is null where nothing was rated."""
    rows = table(spark, d, "feedback", ["id", "aspect_id", "rating"]).distinct()
    return rows.groupBy("aspect_id").agg(F.count_if(c("rating") == "up").alias("up"), F.count_if(c("rating") == "down").alias("down"), F.count("rating").alias("rated")).withColumn("agreement", J.share(c("up"), c("rated")))


def a11_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every decision key, those without rows too, in their order."""
    keys = spark.createDataFrame([(0, "none"), (1, "designer"), (2, "supplier"), (3, "manual")], "place int, decision string")
    word = F.lower(F.trim(c("note_type")))
    counts = table(spark, d, "feedback", ["id", "note_type"]).distinct().groupBy(F.when(word.isin("designer", "supplier", "manual"), word).otherwise("none").alias("decision")).agg(F.count("*").alias("n"))
    return keys.join(counts, "decision", "left").select("place", "decision", F.coalesce("n", F.lit(0)).alias("n"))


def a12_layout_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts of regions of each layout and read."""
    regions = table(spark, d, "regions")
    return regions.groupBy("source_sha256", "read_no").agg(
        F.count("*").alias("regions"),
        F.count_if(c("status") == "manual").alias("manual"),
        F.count_if(c("human_edited")).alias("edited"),
        F.count_if(c("human_confirmed") & ~c("human_edited")).alias("confirmed"),
        F.round(F.avg("mismatch"), 4).alias("mismatch"),
    )


def a13_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row: checks, layouts, months and the share of checks with a violation."""
    checks = table(spark, d, "checks", ["id", "source_sha256", "source_pdf", "ts", "n_violation"]).distinct()
    layout = F.coalesce(F.nullif("source_sha256", F.lit("")), c("source_pdf"))
    return checks.agg(F.count("*").alias("n_checks"), F.count_distinct(layout).alias("n_layouts"), F.count_distinct(F.date_format(T.parse_time(c("ts")), "yyyy-MM")).alias("n_months"), F.round(F.avg((c("n_violation") > 0).cast("int")), 4).alias("violation_share"))


def a16_tally(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and calls of each model, summed from the nested objects in text."""
    used = F.from_json("tokens_json", "map<string, struct<prompt: bigint, completion: bigint, calls: bigint>>")
    rows = table(spark, d, "checks", ["id", "tokens_json"]).distinct().select(F.explode(used).alias("model", "u"))
    return rows.groupBy("model").agg(F.sum("u.prompt").alias("prompt"), F.sum("u.completion").alias("completion"), F.sum("u.calls").alias("calls"), F.count("*").alias("n_checks"))


def a15_main_calls(spark: SparkSession, d: str) -> DataFrame:
    """Of each check the model with the most prompt tokens, and its calls."""
    used = F.from_json("tokens_json", "map<string, struct<prompt: bigint, completion: bigint, calls: bigint>>")
    rows = table(spark, d, "checks", ["id", "tokens_json"]).distinct().select("id", F.explode(used).alias("model", "u"))
    best = rows.groupBy("id").agg(F.max_by(F.struct("model", "u"), F.struct("u.prompt", "model")).alias("b"))
    return best.select("id", c("b.model").alias("model"), c("b.u.calls").alias("calls"))


def a19_vote(spark: SparkSession, d: str) -> DataFrame:
    """The majority of each verdict's votes."""
    rows = table(spark, d, "verdicts", ["id", "votes"]).where("votes is not null").distinct()
    votes = rows.select("id", F.posexplode(F.from_json("votes", "array<string>")).alias("vote_no", "vote"))
    return J.majority(votes, ["id"], "vote", "vote_no")


def a20_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Words of a layout that at least half of its reads have."""
    regions = table(spark, d, "regions", ["source_sha256", "read_no", "text"])
    runs = regions.groupBy("source_sha256").agg(F.count_distinct("read_no").alias("n_runs"))
    words = regions.select("source_sha256", "read_no", F.explode(T.words(c("text"), 5)).alias("word"))
    return J.consensus(words, ["source_sha256"], "word", "read_no", runs).groupBy("source_sha256").agg(F.count("*").alias("n_words"), F.sum("n_seen").alias("n_seen"))


def a04_stability(spark: SparkSession, d: str) -> DataFrame:
    """Whether an aspect has one status over all checks of a layout."""
    layouts = table(spark, d, "checks", ["id", "source_sha256"]).distinct()
    verdicts = table(spark, d, "verdicts", ["id", "check_id", "aspect_id", "status", "applicable"]).distinct()
    rows = verdicts.where("applicable = 1").join(layouts.select(c("id").alias("check_id"), "source_sha256"), "check_id")
    per = rows.groupBy("source_sha256", "aspect_id").agg(F.count_distinct("status").alias("n_statuses"), F.count_distinct("check_id").alias("n_checks")).where("n_checks > 1")
    return per.groupBy("aspect_id").agg(F.count("*").alias("n"), F.count_if(c("n_statuses") == 1).alias("stable"), F.round(F.avg((c("n_statuses") == 1).cast("int")), 4).alias("share"))


def a05_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters in all and by aspect, rows without a rating left out of its denominator."""
    rows = table(spark, d, "feedback", ["id", "aspect_id", "rating", "note"]).distinct()
    return rows.groupingSets([[], [c("aspect_id")]], c("aspect_id")).agg(
        F.grouping("aspect_id").cast("int").alias("total"), F.count("*").alias("n"), F.count("rating").alias("rated"), F.count_if(c("rating") == "up").alias("up"), F.count("note").alias("noted")
    )


def j19_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Models of the checks under the longest of the overlapping name stems."""
    used = F.from_json("tokens_json", "map<string, struct<prompt: bigint, completion: bigint, calls: bigint>>")
    rows = table(spark, d, "checks", ["id", "tokens_json"]).distinct().select("id", F.explode(F.map_keys(used)).alias("model"))
    stems = rows.select(F.explode(F.array(F.substring("model", 1, 4), F.substring("model", 1, 6), F.substring("model", 1, 8))).alias("stem")).distinct()
    return J.longest_prefix(rows, "model", stems, "stem", 16).groupBy("model", "stem").agg(F.count("*").alias("n"))


def j21_names(spark: SparkSession, d: str) -> DataFrame:
    """Feedback with the aspect's name from the dictionary, else the stored one, else a placeholder."""
    feedback = table(spark, d, "feedback", ["id", "loaded_at", "aspect_id", "aspect_name"])
    names = table(spark, d, "aspects", ["aspect_id", "aspect_name"]).withColumnRenamed("aspect_name", "known")
    return feedback.join(names, "aspect_id", "left").select("id", "loaded_at", F.coalesce("known", F.nullif(F.trim("aspect_name"), F.lit("")), F.concat(F.lit("aspect "), c("aspect_id").cast("string"))).alias("name"))


def j22_domain(spark: SparkSession, d: str) -> DataFrame:
    """Every aspect with its verdicts and feedback, 0 where there is none."""
    names = table(spark, d, "aspects", ["aspect_id", "aspect_key"])
    v = table(spark, d, "verdicts", ["id", "aspect_id"]).distinct().groupBy("aspect_id").agg(F.count("*").alias("n_verdicts"))
    f = table(spark, d, "feedback", ["id", "aspect_id"]).distinct().groupBy("aspect_id").agg(F.count("*").alias("n_feedback"))
    return names.join(v, "aspect_id", "left").join(f, "aspect_id", "left").fillna(0, ["n_verdicts", "n_feedback"])


def j20_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts that need work with a person's last decision put over the default, in order of severity and id."""
    verdicts = table(spark, d, "verdicts", ["id", "check_id", "aspect_id", "status", "applicable"]).distinct().where("applicable = 1 and status in ('violation', 'manual') and check_id is not null")
    feedback = table(spark, d, "feedback", ["id", "check_id", "aspect_id", "note_type", "ts"]).distinct().where("check_id is not null")
    word = F.lower(F.trim(c("note_type")))
    last = J.latest_rows(feedback, ["check_id", "aspect_id"], ["ts", "id"]).select("check_id", "aspect_id", F.when(word.isin("designer", "supplier", "manual"), word).alias("decision"))
    joined = verdicts.join(last, ["check_id", "aspect_id"], "left")
    default = F.when(c("status") == "violation", "designer").otherwise("manual")
    return joined.select("id", F.when(c("status") == "violation", 0).otherwise(1).alias("severity"), F.coalesce("decision", default).alias("target"), c("decision").isNotNull().alias("by_person"))


def j26_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Each layout with its first check and that check's scan."""
    checks = table(spark, d, "checks", ["id", "source_sha256", "category_scan"]).where("source_sha256 is not null").distinct()
    return checks.groupBy("source_sha256").agg(F.min("id").alias("first_id"), F.min_by("category_scan", "id").alias("category_scan"))


def c10_journal(spark: SparkSession, d: str) -> DataFrame:
    """Checks with parsed categories, minutes and month."""
    checks = _once(spark, d, "checks")
    categories = F.coalesce(F.from_json("categories", "array<string>"), F.array().cast("array<string>"))
    return checks.select("id", F.array_join(F.array_sort(categories), "|").alias("categories"), F.round(c("seconds") / 60, 1).alias("minutes"), F.date_format(T.parse_time(c("ts")), "yyyy-MM").alias("month"))


def c11_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """The wide counters of the checks as long rows by month."""
    checks = _once(spark, d, "checks").withColumn("month", F.date_format(T.parse_time(c("ts")), "yyyy-MM"))
    long = checks.unpivot(["id", "month"], ["n_violation", "n_manual", "n_ok", "n_na"], "counter", "n")
    return long.groupBy("month", "counter").agg(F.sum("n").alias("n"))


def o04_sorts(spark: SparkSession, d: str) -> DataFrame:
    """Aspects by agreement, the unrated last, with the rank written out."""
    rated = a10_agreement(spark, d)
    order = Window.orderBy(F.asc_nulls_last("agreement"), "aspect_id")  # one row an aspect
    return rated.select("aspect_id", "agreement", F.row_number().over(order).alias("place"))


QUERIES = {
    f.__name__: f
    for f in (s14_append_ids, s15_upsert_latest, s16_desc_limit, s17_backfill, s26_pick_source, a04_stability, a05_counters, a07_check_counts, a08_status_pivot, a09_latest, a10_agreement, a11_decisions, a12_layout_stats, a13_summary)
    + (a15_main_calls, a16_tally, a19_vote, a20_consensus, j19_longest_prefix, j20_overrides, j21_names, j22_domain, j26_first_seen, c10_journal, c11_unpivot, o04_sorts)
}
_TS = "coalesce(try_strptime(substr(ts,1,19), '%Y-%m-%d %H:%M:%S'), try_strptime(substr(ts,1,19), '%Y-%m-%dT%H:%M:%S'))"
_ONCE = "(select * from (select *, row_number() over (partition by id order by loaded_at) as _n from {}) where _n = 1)"
_USED = "(select id, unnest(json_keys(tokens_json)) as model, tokens_json from (select distinct id, tokens_json from checks where tokens_json is not null))"
_FIELD = "cast(json_extract(tokens_json, '$.\"' || model || '\".{}') as bigint)"
_COUNTS = "count(*) filter (where applicable = 1 and status = 'violation') as n_violation, count(*) filter (where applicable = 1 and status = 'manual') as n_manual, count(*) filter (where applicable = 1 and status = 'ok') as n_ok, count(*) filter (where applicable <> 1) as n_na"
_DECISION = "case when lower(trim(note_type)) in ('designer','supplier','manual') then lower(trim(note_type)) else 'none' end"
SQL = {
    "s14_append_ids": "select (select max(id) from feedback) + row_number() over (order by ts, old_id) as id, old_id from (select distinct id as old_id, ts from feedback where check_id is null)",
    "s15_upsert_latest": "select min(id) over (partition by check_id, aspect_id) as id, check_id, aspect_id, rating, note, ts from feedback where check_id is not null qualify row_number() over (partition by check_id, aspect_id order by ts desc nulls last, id desc, loaded_at desc) = 1",
    "s16_desc_limit": "select distinct id, ts, category_scan from checks order by id desc limit 50",
    "s17_backfill": """
with k as (select distinct id, report_path, regexp_extract(report_path, '[^/]+$', 0) as file_name from checks), f as (select file_name, count(distinct report_path) as n_paths from k where report_path is not null group by 1)
select id, k.file_name, coalesce(n_paths, 0) as n_paths from k left join f using (file_name) where id not in (select check_id from verdicts where check_id is not null)""",
    "s26_pick_source": "with m as (select strftime(loaded_at, '%Y-%m') as month, count(distinct id) as n from feedback group by 1) select month, n, month = (select max(month) from m) as picked from m",
    "a04_stability": """
with r as (select v.*, source_sha256 from (select distinct id, check_id, aspect_id, status, applicable from verdicts where applicable = 1) v join (select distinct id as check_id, source_sha256 from checks) using (check_id)),
p as (select source_sha256, aspect_id, count(distinct status) as n_statuses from r group by 1, 2 having count(distinct check_id) > 1)
select aspect_id, count(*) as n, count(*) filter (where n_statuses = 1) as stable, round(avg(case when n_statuses = 1 then 1 else 0 end), 4) as share from p group by 1""",
    "a05_counters": "select aspect_id, grouping(aspect_id)::int as total, count(*) as n, count(rating) as rated, count(*) filter (where rating = 'up') as up, count(note) as noted from (select distinct id, aspect_id, rating, note from feedback) group by grouping sets ((), (aspect_id))",
    "a07_check_counts": f"""
with v as (select check_id, {_COUNTS} from {_ONCE.format('verdicts')} where check_id is not null group by 1)
select id, coalesce(v.n_violation, 0) as n_violation, coalesce(v.n_manual, 0) as n_manual, coalesce(v.n_ok, 0) as n_ok, coalesce(v.n_na, 0) as n_na, k.n_violation::bigint as said from {_ONCE.format('checks')} k left join v on v.check_id = k.id""",
    "a08_status_pivot": f"""
with l as (select max(id) as check_id from checks group by coalesce(source_sha256, source_pdf)), v as (select distinct id, check_id, aspect_id, status, applicable from verdicts where check_id in (select check_id from l)),
r as (select aspect_id, {_COUNTS} from v group by 1)
select r.aspect_id, aspect_name, n_violation, n_manual, n_ok, n_na, coalesce(round((n_violation + n_manual) / nullif(n_violation + n_manual + n_ok, 0), 3), 0.0) as problem_share from r left join aspects using (aspect_id)""",
    "a09_latest": "select coalesce(source_sha256, source_pdf) as layout, max(id) as id from checks group by 1",
    "a10_agreement": "select aspect_id, count(*) filter (where rating = 'up') as up, count(*) filter (where rating = 'down') as down, count(rating) as rated, round(count(*) filter (where rating = 'up') / nullif(count(rating), 0), 3) as agreement from (select distinct id, aspect_id, rating from feedback) group by 1",
    "a11_decisions": f"with k(place, decision) as (values (0,'none'),(1,'designer'),(2,'supplier'),(3,'manual')), n as (select {_DECISION} as decision, count(*) as n from (select distinct id, note_type from feedback) group by 1) select place, decision, coalesce(n, 0) as n from k left join n using (decision)",
    "a12_layout_stats": "select source_sha256, read_no, count(*) as regions, count(*) filter (where status = 'manual') as manual, count(*) filter (where human_edited) as edited, count(*) filter (where human_confirmed and not human_edited) as confirmed, round(avg(mismatch), 4) as mismatch from regions group by 1, 2",
    "a13_summary": f"select count(*) as n_checks, count(distinct coalesce(nullif(source_sha256,''), source_pdf)) as n_layouts, count(distinct strftime({_TS}, '%Y-%m')) as n_months, round(avg(case when n_violation > 0 then 1 else 0 end), 4) as violation_share from (select distinct id, source_sha256, source_pdf, ts, n_violation from checks)",
    "a15_main_calls": f"select id, model, {_FIELD.format('calls')} as calls from {_USED} qualify row_number() over (partition by id order by {_FIELD.format('prompt')} desc, model desc) = 1",
    "a16_tally": f"select model, sum({_FIELD.format('prompt')})::bigint as prompt, sum({_FIELD.format('completion')})::bigint as completion, sum({_FIELD.format('calls')})::bigint as calls, count(*) as n_checks from {_USED} group by 1",
    "a19_vote": """
with v as (select id, unnest(votes) as vote, generate_subscripts(votes, 1) as vote_no from (select distinct id, from_json(votes, '["varchar"]') as votes from verdicts where votes is not null)),
n as (select id, vote, count(*) as n, min(vote_no) as first from v group by 1, 2), b as (select *, sum(n) over (partition by id) as n_votes, row_number() over (partition by id order by n desc, first) as place from n)
select id, case when n > 1 then vote end as winner, n_votes::bigint as n_votes, n as n_winner from b where place = 1""",
    "a20_consensus": r"""
with w as (select source_sha256, read_no, unnest(list_distinct(list_filter(regexp_extract_all(translate(lower(text), 'ё', 'е'), '[\p{L}\p{N}]+'), lambda x: length(x) >= 5))) as word from regions),
s as (select source_sha256, word, count(distinct read_no) as n_seen from w group by 1, 2), r as (select source_sha256, count(distinct read_no) as n_runs from regions group by 1)
select source_sha256, count(*) as n_words, sum(n_seen)::bigint as n_seen from s join r using (source_sha256) where n_seen >= (n_runs + 1) // 2 group by 1""",
    "j19_longest_prefix": f"""
with m as (select id, model from {_USED}), s as (select distinct unnest([substr(model,1,4), substr(model,1,6), substr(model,1,8)]) as stem from m),
b as (select model, max_by(stem, length(stem)) as stem from (select distinct model from m) join s on starts_with(model, stem) group by 1) select m.model, stem, count(*) as n from m left join b using (model) group by all""",
    "j20_overrides": f"""
with v as (select distinct id, check_id, aspect_id, status from verdicts where applicable = 1 and status in ('violation','manual') and check_id is not null),
f as (select check_id, aspect_id, nullif({_DECISION}, 'none') as decision from (select distinct id, check_id, aspect_id, note_type, ts from feedback where check_id is not null) qualify row_number() over (partition by check_id, aspect_id order by ts desc nulls last, id desc) = 1)
select id, case when status = 'violation' then 0 else 1 end as severity, coalesce(decision, case when status = 'violation' then 'designer' else 'manual' end) as target, decision is not null as by_person from v left join f using (check_id, aspect_id)""",
    "j21_names": "select id, loaded_at, coalesce(a.aspect_name, nullif(trim(f.aspect_name), ''), 'aspect ' || f.aspect_id) as name from feedback f left join aspects a using (aspect_id)",
    "j22_domain": "select aspect_id, aspect_key, (select count(distinct id) from verdicts v where v.aspect_id = a.aspect_id) as n_verdicts, (select count(distinct id) from feedback f where f.aspect_id = a.aspect_id) as n_feedback from aspects a",
    "j26_first_seen": "select source_sha256, min(id) as first_id, arg_min(category_scan, id) as category_scan from checks where source_sha256 is not null group by 1",
    "c10_journal": f"""select id, coalesce(array_to_string(list_sort(case when json_valid(categories) then from_json(categories, '["varchar"]') end), '|'), '') as categories, round(seconds / 60, 1) as minutes, strftime({_TS}, '%Y-%m') as month from {_ONCE.format('checks')}""",
    "c11_unpivot": f"select month, counter, sum(n)::bigint as n from (select strftime({_TS}, '%Y-%m') as month, unnest(['n_violation','n_manual','n_ok','n_na']) as counter, unnest([n_violation, n_manual, n_ok, n_na]) as n from {_ONCE.format('checks')}) group by 1, 2",
}
SQL["o04_sorts"] = f"select aspect_id, agreement, row_number() over (order by agreement asc nulls last, aspect_id)::int as place from ({SQL['a10_agreement']})"
