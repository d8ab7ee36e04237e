"""Queries of sampling, quotas, invariants, counters, sources and set operations."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import journal as J
from ..session import cut, ensure_checkpoint_dir
from ..sources import files as S
from ..sources import models as M
from ..sources.tables import table

c = F.col


def s06_scan_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of the documents: the texts are not read."""
    return table(spark, d, "documents", ["doc_id", "lang", "source", "n_chars", "doc_type"])


def s21_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of a run, written as an immutable snapshot and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/snapshots"
    run = next(tempfile._get_candidate_names())
    counts = table(spark, d, "verdicts", ["id", "status"]).distinct().groupBy("status").agg(F.count("*").alias("n"))
    return spark.read.parquet(S.write_snapshot(counts, folder, run))


def s23_drift(spark: SparkSession, d: str) -> DataFrame:
    """Statuses of each aspect before and after a date, where they differ."""
    verdicts = table(spark, d, "verdicts", ["id", "aspect_id", "status", "loaded_at"])
    count = lambda rows: rows.groupBy("aspect_id").agg(F.count_if(c("status") == "violation").alias("violation"), F.count_if(c("status") == "ok").alias("ok"))
    return S.drift(count(verdicts.where("loaded_at < timestamp'2025-01-01'")), count(verdicts.where("loaded_at >= timestamp'2025-01-01'")), ["aspect_id"])


def s27_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Size and hash of each text against what the row says."""
    docs = table(spark, d, "documents", ["doc_id", "text", "n_chars"])
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), (F.length("text").cast("bigint").eqNullSafe(c("n_chars"))).alias("size_ok"))


def r05_cached_queries(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of each aspect that people have rated already, and those that they still must be asked about."""
    prompt = F.concat_ws(":", c("check_id").cast("string"), c("aspect_id").cast("string"))
    wanted = table(spark, d, "verdicts", ["check_id", "aspect_id"]).dropna().distinct().withColumn("key", M.request_key("reviewer", prompt))
    rated = table(spark, d, "feedback", ["check_id", "aspect_id", "rating"]).dropna().select(M.request_key("reviewer", prompt).alias("key"), c("rating").alias("answer"))
    hit, miss = M.cached(wanted, rated)
    rows = hit.select("aspect_id", F.lit(True).alias("cached")).unionByName(miss.select("aspect_id", F.lit(False).alias("cached")))
    return rows.groupBy("aspect_id", "cached").agg(F.count("*").alias("n"))


def s11_answers(spark: SparkSession, d: str) -> DataFrame:
    """The aspect that each way of writing an aspect's name is nearest to, by vectors of the names.

    The aspects' own names are the cache of an earlier run; only names that it lacks go to the model.
    """
    keyed = lambda names: names.withColumn("key", M.request_key("trigrams", c("prompt")))
    aspects = keyed(table(spark, d, "aspects", ["aspect_id", "aspect_name"]).withColumnRenamed("aspect_name", "prompt"))
    cache = cut(M.ask(aspects, M.trigram_vectors))
    names = keyed(table(spark, d, "feedback", ["aspect_name"]).where("trim(aspect_name) <> ''").select(c("aspect_name").alias("prompt")).distinct())
    vectors = M.answer_all(names, cache, M.trigram_vectors).select("prompt", F.from_json("answer", "array<double>").alias("v"))
    own = aspects.join(cache, "key").select("aspect_id", F.from_json("answer", "array<double>").alias("w"))
    likeness = F.round(F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x), 4)
    pairs = vectors.join(F.broadcast(own)).withColumn("likeness", likeness)  # aspects are a fixed list
    return pairs.groupBy(c("prompt").alias("aspect_name")).agg(F.max_by(F.struct("aspect_id", "likeness"), F.struct("likeness", -c("aspect_id"))).alias("best")).select("aspect_name", "best.aspect_id", "best.likeness")


def a06_field_score(spark: SparkSession, d: str) -> DataFrame:
    """Regions by language and outcome, with the share of those that were read."""
    regions = table(spark, d, "regions", ["region_key", "lang", "status", "text"])
    return regions.groupBy("lang").agg(
        F.count_if(c("status") == "read").alias("exact"), F.count_if(c("status") == "manual").alias("distorted"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("missed"), F.round(F.avg((c("status") == "read").cast("int")), 4).alias("share")
    )


def a21_lang_summary(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of regions of each layout that no Russian region has."""
    regions = table(spark, d, "regions", ["source_sha256", "kind", "lang"])
    kinds = regions.groupBy("source_sha256").agg(F.collect_set("kind").alias("every"), F.collect_set(F.when(c("lang") == "ru", c("kind"))).alias("russian"))
    return kinds.select("source_sha256", F.array_join(F.array_sort(F.array_except("every", "russian")), "|").alias("without_russian"))


def a22_passport(spark: SparkSession, d: str) -> DataFrame:
    """Documents in all, by language and by type, with the number of different texts."""
    docs = table(spark, d, "documents", ["doc_id", "lang", "doc_type", "text"]).withColumn("key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return docs.groupingSets([[], [c("lang")], [c("doc_type")]], c("lang"), c("doc_type")).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.count_distinct("key").alias("n_texts"))


def a25_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Invariants of the chunks: texts above the limit, small ones, repeated ids, ids with several texts."""
    chunks = table(spark, d, "chunks", ["chunk_id", "text"])
    one = chunks.agg(F.count_if(F.length("text") > 3500).alias("above"), F.count_if(F.length("text") < 120).alias("small"), F.max(F.length("text")).cast("bigint").alias("longest"), F.count("*").alias("n"))
    repeated = E.duplicates(chunks, ["chunk_id"]).agg(F.count("*").alias("repeated"))
    torn = E.duplicates(chunks.distinct(), ["chunk_id"]).agg(F.count("*").alias("torn"))
    long = [one.select(F.lit(x).alias("what"), c(x).alias("n")) for x in ("above", "small", "longest", "n")]
    out = repeated.select(F.lit("repeated").alias("what"), c("repeated").alias("n")).unionByName(torn.select(F.lit("torn").alias("what"), c("torn").alias("n")))
    for x in long:
        out = out.unionByName(x)
    return out


def a26_quota(spark: SparkSession, d: str) -> DataFrame:
    """300 documents shared out to the sources: 5 each at least, the rest by largest remainder."""
    sources = table(spark, d, "documents", ["source"]).groupBy(F.coalesce("source", F.lit("<none>")).alias("source")).agg(F.count("*").alias("have"))
    return E.allocate(sources, "source", "have", 300, 5)


def c12_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five documents of each type and language in seeded order, and five in reserve."""
    docs = table(spark, d, "documents", ["doc_id", "doc_type", "lang"])
    return E.stratified(docs, ["doc_type", "lang"], "doc_id", 5, 20260830).select("doc_type", "lang", "doc_id", "place", "reserve")


def a27_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Of each region's kind the most frequent width in hundredths, and the share far from it."""
    boxes = table(spark, d, "regions", ["kind", "x0", "x1"]).where("x0 is not null and x1 is not null").select("kind", F.round((c("x1") - c("x0")) * 100).cast("int").alias("w"))
    counts = boxes.groupBy("kind", "w").agg(F.count("*").alias("n"))
    mode = counts.groupBy("kind").agg(F.max_by("w", F.struct("n", -c("w"))).alias("mode"), F.sum("n").alias("all"))
    return counts.join(mode, "kind").groupBy("kind", "mode").agg(F.round(F.sum(F.when(F.abs(c("w") - c("mode")) > 5, c("n")).otherwise(0)) / F.max("all"), 4).alias("far"))


def a28_basis_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of the checks of each month whose layout has a region of composition."""
    checks = table(spark, d, "checks", ["id", "source_sha256", "ts"]).distinct()
    have = table(spark, d, "regions", ["source_sha256", "kind"]).where("kind = 'composition'").select("source_sha256", F.lit(1).alias("has")).distinct()
    rows = checks.join(have, "source_sha256", "left").withColumn("month", F.date_format(T.parse_time(c("ts")), "yyyy-MM"))
    return rows.groupBy("month").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("has", F.lit(0))), 4).alias("share"))


def a29_findings(spark: SparkSession, d: str) -> DataFrame:
    """Of each layout the first eight words in only one of its regions, sorted, and how many more there are."""
    words = table(spark, d, "regions", ["source_sha256", "region_key", "text"]).select("source_sha256", "region_key", F.explode(T.words(c("text"), 5)).alias("word"))
    rare = words.groupBy("source_sha256", "word").agg(F.count_distinct("region_key").alias("n")).where("n = 1")
    first = rare.withColumn("place", F.row_number().over(Window.partitionBy("source_sha256").orderBy("word"))).where("place <= 8")
    examples = first.groupBy("source_sha256").agg(F.array_join(F.array_sort(F.collect_list("word")), "|").alias("examples"))
    return rare.groupBy("source_sha256").agg(F.count("*").alias("n")).join(examples, "source_sha256")


def j07_zip_assert(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a document side by side with the next by position, the position checked."""
    chunks = table(spark, d, "chunks", ["chunk_id", "text"]).distinct().select(F.regexp_extract("chunk_id", "^(.*):", 1).alias("document"), F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("int").alias("place"), F.length("text").cast("bigint").alias("n"))
    after = chunks.select("document", (c("place") - 1).alias("place"), c("n").alias("n_next"))
    return chunks.join(after, ["document", "place"], "left").select("document", "place", "n", "n_next")


def j03_semi(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of regulations that some document names."""
    named = table(spark, d, "documents", ["regulation_id"]).where("regulation_id is not null").distinct()
    return table(spark, d, "chunks", ["chunk_id", "regulation_id"]).distinct().join(named, "regulation_id", "left_semi").select("chunk_id", "regulation_id")


def j06_budget(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each clause taken in order while they fit a budget of 4,000 characters; one that does not fit is passed over.

    The order decides, so a clause is one list; it holds ids and lengths only, never texts.
    """
    chunks = table(spark, d, "chunks", ["chunk_id", "regulation_id", "section", "text"]).distinct()
    groups = chunks.groupBy("regulation_id", "section").agg(F.array_sort(F.collect_list(F.struct("chunk_id", F.length("text").alias("n")))).alias("all"))
    start = F.struct(F.lit(4000).alias("left"), F.array().cast("array<string>").alias("ids"))
    take = lambda acc, x: F.when(x["n"] <= acc["left"], F.struct((acc["left"] - x["n"]).alias("left"), F.concat(acc["ids"], F.array(x["chunk_id"])).alias("ids"))).otherwise(acc)
    done = F.aggregate("all", start, take)
    return groups.select("regulation_id", "section", F.size(done["ids"]).alias("n_taken"), (4000 - done["left"]).alias("used"), F.size("all").alias("n"))


def j04_first_match(spark: SparkSession, d: str) -> DataFrame:
    """Of each additive code on a label the first table row of each regulation that names it."""
    codes = table(spark, d, "regions", ["text"]).select(F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit("[EЕ]([0-9]{3})"), F.lit(1)))).alias("code")).distinct()
    rows = table(spark, d, "chunks", ["chunk_id", "regulation_id", "text", "is_table"]).where("is_table").distinct()
    found = rows.select("regulation_id", "chunk_id", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit("[EЕ]([0-9]{3})"), F.lit(1)))).alias("code"))
    return found.join(codes, "code").groupBy("code", "regulation_id").agg(F.min("chunk_id").alias("chunk_id"), F.count("*").alias("n_chunks"))


def x01_sets(spark: SparkSession, d: str) -> DataFrame:
    """Intersection, differences and union of the layouts of checks and regions."""
    a = table(spark, d, "checks", ["source_sha256"]).where("source_sha256 is not null")
    b = table(spark, d, "regions", ["source_sha256"]).where("source_sha256 is not null")
    parts = {"both": a.intersect(b), "checks only": a.subtract(b), "regions only": b.subtract(a), "either": a.union(b).distinct()}
    out = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("part"), "source_sha256")
        out = one if out is None else out.unionByName(one)
    return out


def star_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by region and year over the star schema: filters and columns reach the scans."""
    lines = table(spark, d, "lineitem", ["l_orderkey", "l_extendedprice", "l_discount", "l_returnflag"]).where("l_returnflag <> 'R'")
    orders = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    customers = table(spark, d, "customer", ["c_custkey", "c_nationkey"])
    nations = table(spark, d, "nation", ["n_nationkey", "n_regionkey"])
    regions = table(spark, d, "region", ["r_regionkey", "r_name"])
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customers, c("o_custkey") == c("c_custkey")).join(nations, c("c_nationkey") == c("n_nationkey")).join(regions, c("n_regionkey") == c("r_regionkey"))
    return rows.groupBy("r_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


def star_quantity(spark: SparkSession, d: str) -> DataFrame:
    """Quantity of each brand and supplier nation."""
    lines = table(spark, d, "lineitem", ["l_partkey", "l_suppkey", "l_quantity"])
    parts = table(spark, d, "part", ["p_partkey", "p_brand"])
    suppliers = table(spark, d, "supplier", ["s_suppkey", "s_nationkey"])
    return lines.join(parts, c("l_partkey") == c("p_partkey")).join(suppliers, c("l_suppkey") == c("s_suppkey")).groupBy("p_brand", "s_nationkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


def latest_event(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user and type."""
    events = table(spark, d, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return J.latest_rows(events, ["user_id", "event_type"], ["ts", "event_id"])


QUERIES = {
    f.__name__: f
    for f in (s06_scan_pruned, s21_snapshot, s23_drift, s27_integrity, r05_cached_queries, s11_answers, a06_field_score, a21_lang_summary, a22_passport, a25_invariants, a26_quota, c12_sample, a27_histogram, a28_basis_share, a29_findings)
    + (j03_semi, j04_first_match, j06_budget, j07_zip_assert, x01_sets, star_revenue, star_quantity, latest_event)
}
_TS = "coalesce(try_strptime(substr(ts,1,19), '%Y-%m-%d %H:%M:%S'), try_strptime(substr(ts,1,19), '%Y-%m-%dT%H:%M:%S'))"
_CODES = "unnest(list_distinct(regexp_extract_all(upper(text), '[EЕ]([0-9]{3})', 1)))"
SQL = {
    "s06_scan_pruned": "select doc_id, lang, source, n_chars, doc_type from documents",
    "s21_snapshot": "select status, count(*) as n from (select distinct id, status from verdicts) group by 1",
    "s23_drift": """
with k as (select aspect_id, loaded_at < timestamp '2025-01-01' as early, count(*) filter (where status = 'violation')::double as violation, count(*) filter (where status = 'ok')::double as ok from verdicts group by 1, 2),
l as (select aspect_id, early, unnest(['violation', 'ok']) as metric, unnest([violation, ok]) as n from k)
select aspect_id, metric, a.n as old, b.n as new from (select * from l where early) a full join (select * from l where not early) b using (aspect_id, metric) where a.n is distinct from b.n""",
    "s27_integrity": "select doc_id, sha256(text) as sha256, length(text) is not distinct from n_chars as size_ok from documents",
    "r05_cached_queries": "with v as (select distinct check_id, aspect_id from verdicts where check_id is not null and aspect_id is not null), r as (select distinct check_id, aspect_id from feedback where check_id is not null and aspect_id is not null and rating is not null) select aspect_id, r.check_id is not null as cached, count(*) as n from v left join r using (check_id, aspect_id) group by 1, 2",
    "a06_field_score": "select lang, count(*) filter (where status = 'read') as exact, count(*) filter (where status = 'manual') as distorted, count(*) filter (where trim(coalesce(text, '')) = '') as missed, round(avg(case when status = 'read' then 1 when status is not null then 0 end), 4) as share from regions group by 1",
    "a21_lang_summary": "with k as (select source_sha256, kind, bool_or(coalesce(lang = 'ru', false)) as russian from regions where kind is not null group by 1, 2) select source_sha256, coalesce(string_agg(kind, '|' order by kind) filter (where not russian), '') as without_russian from k group by 1",
    "a22_passport": "select lang, doc_type, grouping(lang, doc_type)::int as level, count(*) as n, count(distinct md5(coalesce(text, ''))) as n_texts from documents group by grouping sets ((), (lang), (doc_type))",
    "a25_invariants": """
with k as (select chunk_id, text from chunks), u as (select distinct * from k)
select 'above' as what, count(*) as n from k where length(text) > 3500 union all select 'small', count(*) from k where length(text) < 120 union all select 'longest', max(length(text)) from k union all select 'n', count(*) from k
union all select 'repeated', count(*) from (select chunk_id from k group by 1 having count(*) > 1) union all select 'torn', count(*) from (select chunk_id from u group by 1 having count(*) > 1)""",
    "a26_quota": """
with k as (select coalesce(source, '<none>') as source, count(*) as have from documents group by 1), l as (select *, least(have, 5) as low from k), r as (select *, have - low as room, 300 - sum(low) over () as left_ from l),
e as (select *, least(left_ * room / sum(room) over ()::double, room) as exact from r), w as (select *, floor(exact) as whole from e), p as (select *, least(left_, sum(room) over ()) - sum(whole) over () as rest, row_number() over (order by round(exact - whole, 9) desc, source) as place from w)
select source, have, (low + whole + case when place <= rest and whole < room then 1 else 0 end)::bigint as share from p""",
    "c12_sample": "select doc_type, lang, doc_id, place::int as place, place > 5 as reserve from (select *, row_number() over (partition by doc_type, lang order by md5('20260830:' || doc_id), doc_id) as place from documents) where place <= 10",
    "a27_histogram": "with b as (select kind, round((x1 - x0) * 100)::int as w from regions where x0 is not null and x1 is not null), n as (select kind, w, count(*) as n from b group by 1, 2), m as (select kind, w as mode from n qualify row_number() over (partition by kind order by n desc, w) = 1) select n.kind, mode, round(sum(case when abs(w - mode) > 5 then n else 0 end) / sum(n), 4) as far from n join m on n.kind is not distinct from m.kind group by 1, 2",
    "a28_basis_share": f"select strftime({_TS}, '%Y-%m') as month, count(*) as n, round(avg(case when source_sha256 in (select source_sha256 from regions where kind = 'composition') then 1 else 0 end), 4) as share from (select distinct id, source_sha256, ts from checks) group by 1",
    "a29_findings": r"with w as (select source_sha256, region_key, unnest(list_distinct(list_filter(regexp_extract_all(translate(lower(text), 'ё', 'е'), '[\p{L}\p{N}]+'), lambda x: length(x) >= 5))) as word from regions), r as (select source_sha256, word from w group by 1, 2 having count(distinct region_key) = 1) select source_sha256, array_to_string(list_sort(list(word))[1:8], '|') as examples, count(*) as n from r group by 1",
    "j03_semi": "select distinct chunk_id, regulation_id from chunks where regulation_id in (select regulation_id from documents where regulation_id is not null)",
    "j04_first_match": f"with c as (select distinct {_CODES} as code from regions), f as (select distinct regulation_id, chunk_id, {_CODES} as code from (select distinct regulation_id, chunk_id, text from chunks where is_table)) select code, regulation_id, min(chunk_id) as chunk_id, count(*) as n_chunks from f join c using (code) group by 1, 2",
    "j07_zip_assert": "with k as (select regexp_extract(chunk_id, '^(.*):', 1) as document, regexp_extract(chunk_id, '(\\d+)$', 1)::int as place, length(text) as n from (select distinct chunk_id, text from chunks)) select a.document, a.place, a.n, b.n as n_next from k a left join k b on a.document = b.document and b.place = a.place + 1",
    "x01_sets": "with a as (select distinct source_sha256 from checks where source_sha256 is not null), b as (select distinct source_sha256 from regions where source_sha256 is not null) select 'both' as part, source_sha256 from (from a intersect from b) union all select 'checks only', source_sha256 from (from a except from b) union all select 'regions only', source_sha256 from (from b except from a) union all select 'either', source_sha256 from (from a union from b)",
    "star_revenue": "select r_name, year(o_orderdate)::int as year, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where l_returnflag <> 'R' group by 1, 2",
    "star_quantity": "select p_brand, s_nationkey, sum(l_quantity) as quantity, count(*) as n from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey group by 1, 2",
    "latest_event": "select event_id, ts, user_id, event_type, value from events qualify row_number() over (partition by user_id, event_type order by ts desc nulls last, event_id desc) = 1",
}
