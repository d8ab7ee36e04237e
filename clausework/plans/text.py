"""Queries of the text functions and of projections and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import segments as S
from ..sources.tables import table

c = F.col
join = lambda a: F.array_join(a, "|")


def p01_header(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    head = T.header(c("regulation_name"), c("section"), c("subsection"), F.when(c("appendix").isNotNull(), F.concat(F.lit("Приложение "), c("appendix"))))
    return chunks.select("chunk_id", head.alias("header"), F.length(T.header_and_text(head, c("text"))).cast("bigint").alias("n_chars"))


def p03_category(spark: SparkSession, d: str) -> DataFrame:
    """Category by first match, and a key that is the address for body clauses and the id for the rest."""
    chunks = table(spark, d, "chunks", ["chunk_id", "regulation_id", "section", "subsection", "clause", "appendix", "is_table"])
    category = F.when(c("is_table"), "table").when(c("clause").isNotNull() & c("appendix").isNotNull(), "appendix_clause").when(c("clause").isNotNull(), "body_clause").otherwise("no_number")
    parts = [F.coalesce(c(x), F.lit("<none>")) for x in ("regulation_id", "section", "subsection", "clause")]
    key = F.when(category == "body_clause", F.concat_ws("|", *parts)).otherwise(c("chunk_id"))
    return chunks.select("chunk_id", category.alias("category"), key.alias("match_key"))


def p11_normalize_enum(spark: SparkSession, d: str) -> DataFrame:
    """A dirty column brought to its four keys; blanks, case, nulls and unknown words fall to 'none'."""
    word = F.lower(F.trim(c("note_type")))
    key = F.when(word.isin("designer", "supplier", "manual"), word).otherwise("none")
    return table(spark, d, "feedback", ["note_type"]).groupBy(c("note_type").alias("stored"), key.alias("note_type")).agg(F.count("*").alias("n"))


def p12_validate_rows(spark: SparkSession, d: str) -> DataFrame:
    """Problems of each row as a list; later tests are skipped where an earlier one already says why."""
    checks = {
        "no check": c("check_id").isNull(),
        "no aspect": c("aspect_id").isNull(),
        "unknown status": ~F.coalesce(c("status"), F.lit("")).isin("violation", "manual", "ok"),
        "negative citations": c("n_citations") < 0,
        "citations of a row that does not apply": (c("applicable") == 0) & (c("n_citations") > 0),
    }
    problems = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in checks.items())), lambda x: x.isNotNull())
    return table(spark, d, "verdicts").select("id", "loaded_at", join(problems).alias("problems")).where("problems <> ''")


def p13_question_gate(spark: SparkSession, d: str) -> DataFrame:
    """Length, a question mark, and no words that point at their own place in the text."""
    key = T.norm_text(c("item_text"))
    problems = F.filter(
        F.array(
            F.when(~F.length("item_text").between(15, 300), "length"),
            F.when(~c("item_text").contains("?"), "no question"),
            F.when(key.rlike(r"(этот|данный|настоящий) (пункт|раздел|документ)|this (clause|section)"), "points at its place"),
            F.when(key.rlike(r"пункт[а-я]* [0-9]|clause [0-9]"), "names the clause"),
        ),
        lambda x: x.isNotNull(),
    )
    return table(spark, d, "eval_items").select("item_id", join(problems).alias("problems"))


def _layout_names(spark: SparkSession, d: str) -> DataFrame:
    """(layout, name, n_checks): layouts numbered by their first appearance."""
    checks = table(spark, d, "checks", ["id", "source_sha256", "source_pdf"])
    first = checks.groupBy(F.coalesce("source_sha256", "source_pdf").alias("layout")).agg(F.min("id").alias("first_id"), F.count("*").alias("n_checks"))
    numbered = S.Ordered(first, [], ["first_id"]).running(F.lit(1), "number").done()
    return numbered.select("layout", F.format_string("layout-%06d", "number").alias("name"), "n_checks")


def p21_anonymize(spark: SparkSession, d: str) -> DataFrame:
    """Layouts named by first appearance, with hashes of the new names."""
    return _layout_names(spark, d).select("name", F.sha2("name", 256).alias("sha256"), "n_checks")


def p21_notes(spark: SparkSession, d: str) -> DataFrame:
    """Feedback under the new names of its layouts: notes masked letter by letter, the path blank."""
    layouts = table(spark, d, "checks", ["id", "source_sha256", "source_pdf"]).select(c("id").alias("check_id"), F.coalesce("source_sha256", "source_pdf").alias("layout")).distinct()
    named = layouts.join(_layout_names(spark, d).drop("n_checks"), "layout").select("check_id", "name")
    masked = F.regexp_replace(F.regexp_replace("note", r"\p{L}", "x"), r"[0-9]", "0")
    rows = table(spark, d, "feedback", ["id", "check_id", "note", "loaded_at"])
    return rows.join(named, "check_id", "left").select("id", "loaded_at", "name", masked.alias("note"), F.lit("").alias("report_path"))


def p06_facts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of regions that hold facts, with their reliability, cut for display."""
    regions = table(spark, d, "regions", ["region_key", "kind", "text", "status"])
    kept = regions.where("kind <> 'technical' and trim(coalesce(text, '')) <> ''")
    return kept.select("region_key", F.substring(T.squeeze(c("text")), 1, 200).alias("fact"), (c("status") == "read").alias("reliable"))


def p18_notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feedback", ["id", "check_id", "note"]).where("trim(coalesce(note, '')) <> ''").distinct()


def p07_optional_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Addresses with optional parts against chunks: a prefix of a subsection ends at its full stop, none matches all of the regulation.

    The addresses are the distinct subsections of the corpus and the regulations alone. Each chunk offers the beginnings
    of its own subsection, so that the join is one of equal keys.
    """
    chunks = table(spark, d, "chunks", ["chunk_id", "regulation_id", "subsection"]).distinct()
    rules = chunks.select("regulation_id", c("subsection").alias("prefix")).distinct()
    bare = F.regexp_replace("subsection", r"\.$", "")
    offered = F.array_append(F.coalesce(S.prefixes(bare), F.array().cast("array<string>")), F.lit(None).cast("string"))
    starts = chunks.select("chunk_id", "regulation_id", F.explode(offered).alias("bare")).distinct()
    wanted = rules.select("regulation_id", "prefix", F.regexp_replace("prefix", r"\.$", "").alias("bare"))
    same = (F.col("a.regulation_id") == F.col("b.regulation_id")) & F.col("a.bare").eqNullSafe(F.col("b.bare"))
    return starts.alias("a").join(wanted.alias("b"), same).groupBy("b.regulation_id", "prefix").agg(F.count_distinct("chunk_id").alias("n_chunks"))


def p16_missing_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Required kinds that a layout lacks, neither by label nor by a word in a text."""
    regions = table(spark, d, "regions", ["source_sha256", "kind", "text"])
    seen = regions.groupBy("source_sha256").agg(
        F.max((c("kind") == "composition") | F.coalesce(F.lower("text").contains("состав"), F.lit(False))).alias("composition"),
        F.max((c("kind") == "manufacturer") | F.coalesce(F.lower("text").contains("изготовитель"), F.lit(False))).alias("manufacturer"),
        F.max((c("kind") == "net_weight") | F.coalesce(F.lower("text").contains("масса нетто"), F.lit(False))).alias("net_weight"),
    )
    long = seen.unpivot(["source_sha256"], ["composition", "manufacturer", "net_weight"], "kind", "present")
    return long.where("not present").select("source_sha256", "kind")


def p19_remark_filter(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of readings of one block that differ by more than punctuation at their end, with Cyrillic text."""
    bare = F.regexp_replace("text", r"[ .,;:!?]+$", "")
    blocks = (
        table(spark, d, "regions", ["source_sha256", "region_id", "text"])
        .where("text is not null and text rlike '[а-яА-Я]'")
        .groupBy("source_sha256", "region_id")
        .agg(F.count_distinct("text").alias("n_forms"), F.count_distinct(bare).alias("n_bare"))
    )
    return blocks.where("n_bare > 1")


def p24_path_rules(spark: SparkSession, d: str) -> DataFrame:
    """Paths against an ordered list of forbidden patterns with an exception; the first reason wins."""
    path = c("report_path")
    reason = F.when(path.isNull(), F.lit(None)).when(path.rlike(r"^reports/ui/"), F.lit(None)).when(path.contains("/old/"), "old report").when(path.rlike(r"\.json$"), "json outside ui").otherwise("other")
    return table(spark, d, "checks", ["id", "report_path"]).select("report_path", reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count_distinct("report_path").alias("n_paths"))


def p25_conditional_update(spark: SparkSession, d: str) -> DataFrame:
    """An edit of some regions with its history, no-ops told apart."""
    regions = table(spark, d, "regions", ["region_key", "text", "human_edited"])
    new_text = T.squeeze(c("text"))
    changed = F.coalesce(c("text") != new_text, F.lit(False))
    return regions.select(
        "region_key",
        changed.alias("changed"),
        (F.coalesce(c("human_edited"), F.lit(False)) | changed).alias("human_edited"),
        F.when(changed, F.length(new_text) - F.length("text")).otherwise(0).cast("bigint").alias("growth"),
    )


def f01_norm(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", ["doc_id", "text"])
    return docs.select("doc_id", F.md5(T.norm_text(c("text")).cast("binary")).alias("norm_md5"))


def f02_question_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", T.question_key(c("item_text")).alias("key"))


def f03_codes(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "regions", ["region_key", "text"])
    return regions.select("region_key", join(T.additive_codes(c("text"))).alias("codes")).where("codes <> ''")


def f05_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "regions", ["region_key", "text"]).select("region_key", F.size(T.words(c("text"))).cast("bigint").alias("n_words")).where("n_words >= 0")


def f07_digit_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", ["doc_id", "text"])
    return docs.select("doc_id", join(T.digit_runs(c("text"), 4)).alias("runs")).where("runs <> ''")


def f09_fold(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", ["doc_id", "text"])
    return docs.select("doc_id", F.md5(T.fold_look_alikes(c("text")).cast("binary")).alias("folded_md5"), (c("text").rlike("[а-яё]") & c("text").rlike("[a-z]")).alias("both_scripts"))


def f18_times(spark: SparkSession, d: str) -> DataFrame:
    checks = table(spark, d, "checks", ["id", "ts", "seconds", "loaded_at"])
    at = T.parse_time(c("ts"))
    return checks.select("id", "loaded_at", at.alias("at"), F.round(c("seconds") / 60, 1).alias("minutes"))


def f21_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", ["doc_id", "source", "text"]).where("text is not null").select("doc_id", T.short_hash(F.coalesce("source", F.lit("")), c("text")).alias("key"))


def f22_ean13(spark: SparkSession, d: str) -> DataFrame:
    prefix = F.lpad(c("o_orderkey").cast("string"), 12, "0")
    return table(spark, d, "orders", ["o_orderkey"]).select("o_orderkey", F.concat(prefix, T.ean13_digit(prefix).cast("string")).alias("ean"))


def f14_energy(spark: SparkSession, d: str) -> DataFrame:
    """Energy stated on a label against the energy of its fats, carbohydrates and proteins."""
    text = c("text")
    value = lambda label: T.number(F.nullif(F.regexp_extract(text, rf"{label} ([0-9]+(?:,[0-9]+)?) г", 1), F.lit("")))
    stated = T.number(F.nullif(F.regexp_extract(text, r"([0-9]+(?:,[0-9]+)?) ккал", 1), F.lit("")))
    parts = table(spark, d, "regions", ["region_key", "text"]).where("text like '%белки%'").select("region_key", value("белки").alias("protein"), value("жиры").alias("fat"), value("углеводы").alias("carbs"), stated.alias("kcal"))
    counted = F.round(4 * c("protein") + 9 * c("fat") + 4 * c("carbs"), 1)
    return parts.select("region_key", counted.alias("counted"), "kcal", F.round(F.abs(c("kcal") - counted) / F.nullif(counted, F.lit(0.0)) * 100, 1).alias("deviation"))


def f28_json(spark: SparkSession, d: str) -> DataFrame:
    """Lists and nested objects in text, malformed ones as empty."""
    checks = table(spark, d, "checks", ["id", "categories", "tokens_json", "loaded_at"])
    categories = F.coalesce(F.from_json("categories", "array<string>"), F.array().cast("array<string>"))
    used = F.from_json("tokens_json", "map<string, struct<prompt: bigint, completion: bigint, calls: bigint>>")
    return checks.select(
        "id",
        "loaded_at",
        F.array_join(F.array_sort(categories), "|").alias("categories"),
        F.aggregate(F.map_values(used), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["prompt"], F.lit(0))).alias("prompt"),
        F.array_join(F.array_sort(F.map_keys(used)), "|").alias("models"),
    )


QUERIES = {
    f.__name__: f
    for f in (p01_header, p03_category, p11_normalize_enum, p12_validate_rows, p13_question_gate, p21_anonymize, p21_notes, p06_facts, p18_notes, p07_optional_predicate, p16_missing_kinds, p19_remark_filter, p24_path_rules, p25_conditional_update)
    + (f01_norm, f02_question_key, f03_codes, f05_words, f07_digit_runs, f09_fold, f18_times, f21_hash, f22_ean13, f14_energy, f28_json)
}
_HEAD = "concat_ws('. ', nullif(regulation_name,''), nullif(section,''), nullif(subsection,''), case when appendix is not null then 'Приложение ' || appendix end)"


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{1680}}\x{{85}}\x{{2028}}\x{{2029}}\x0b]+', ' ', 'g'))"


def _norm(x: str) -> str:
    return _squeeze(f"translate(lower({x}), 'ё', 'е')")


SQL = {
    "p01_header": f"select chunk_id, {_HEAD} as header, length(case when {_HEAD} <> '' then {_HEAD} || chr(10) || text else text end)::bigint as n_chars from chunks",
    "p03_category": """
with k as (select *, case when is_table then 'table' when clause is not null and appendix is not null then 'appendix_clause' when clause is not null then 'body_clause' else 'no_number' end as category from chunks)
select chunk_id, category, case when category = 'body_clause' then concat_ws('|', coalesce(regulation_id,'<none>'), coalesce(section,'<none>'), coalesce(subsection,'<none>'), coalesce(clause,'<none>')) else chunk_id end as match_key from k""",
    "p11_normalize_enum": "select note_type as stored, case when lower(trim(note_type)) in ('designer','supplier','manual') then lower(trim(note_type)) else 'none' end as note_type, count(*) as n from feedback group by 1, 2",
    "p12_validate_rows": """
select * from (select id, loaded_at, concat_ws('|', case when check_id is null then 'no check' end, case when aspect_id is null then 'no aspect' end,
 case when coalesce(status,'') not in ('violation','manual','ok') then 'unknown status' end, case when n_citations < 0 then 'negative citations' end,
 case when applicable = 0 and n_citations > 0 then 'citations of a row that does not apply' end) as problems from verdicts) where problems <> ''""",
    "p13_question_gate": f"""
with k as (select *, {_norm('item_text')} as key from eval_items)
select item_id, concat_ws('|', case when length(item_text) not between 15 and 300 then 'length' end, case when not contains(item_text,'?') then 'no question' end,
 case when regexp_matches(key, '(этот|данный|настоящий) (пункт|раздел|документ)|this (clause|section)') then 'points at its place' end,
 case when regexp_matches(key, 'пункт[а-я]* [0-9]|clause [0-9]') then 'names the clause' end) as problems from k""",
    "p21_anonymize": "with f as (select coalesce(source_sha256, source_pdf) as layout, min(id) as first_id, count(*) as n_checks from checks group by 1), n as (select format('layout-{:06d}', row_number() over (order by first_id, layout)) as name, n_checks from f) select name, sha256(name) as sha256, n_checks from n",
    "p21_notes": r"with f as (select coalesce(source_sha256, source_pdf) as layout, min(id) as first_id from checks group by 1), n as (select layout, format('layout-{:06d}', row_number() over (order by first_id, layout)) as name from f), l as (select distinct id as check_id, coalesce(source_sha256, source_pdf) as layout from checks) select id, loaded_at, name, regexp_replace(regexp_replace(note, '\p{L}', 'x', 'g'), '[0-9]', '0', 'g') as note, '' as report_path from feedback left join (from l join n using (layout)) using (check_id)",
    "p06_facts": f"select region_key, substr({_squeeze('text')}, 1, 200) as fact, status = 'read' as reliable from regions where kind <> 'technical' and trim(coalesce(text,'')) <> ''",
    "p18_notes": "select distinct id, check_id, note from feedback where trim(coalesce(note,'')) <> ''",
    "p07_optional_predicate": """
with k as (select distinct chunk_id, regulation_id, subsection from chunks), r as (select distinct regulation_id, subsection as prefix from k)
select k.regulation_id, prefix, count(distinct chunk_id) as n_chunks from k join r on k.regulation_id = r.regulation_id and (prefix is null or rtrim(subsection, '.') = rtrim(prefix, '.') or starts_with(subsection, rtrim(prefix, '.') || '.')) group by 1, 2""",
    "p16_missing_kinds": """
with s as (select source_sha256, bool_or(coalesce(kind = 'composition', false) or coalesce(contains(lower(text),'состав'), false)) as composition,
 bool_or(coalesce(kind = 'manufacturer', false) or coalesce(contains(lower(text),'изготовитель'), false)) as manufacturer,
 bool_or(coalesce(kind = 'net_weight', false) or coalesce(contains(lower(text),'масса нетто'), false)) as net_weight from regions group by 1)
select source_sha256, 'composition' as kind from s where not composition union all select source_sha256, 'manufacturer' from s where not manufacturer union all select source_sha256, 'net_weight' from s where not net_weight""",
    "p19_remark_filter": "select source_sha256, region_id, count(distinct text) as n_forms, count(distinct regexp_replace(text, '[ .,;:!?]+$', '')) as n_bare from regions where text is not null and regexp_matches(text, '[а-яА-Я]') group by 1, 2 having count(distinct regexp_replace(text, '[ .,;:!?]+$', '')) > 1",
    "p24_path_rules": r"select reason, count(distinct report_path) as n_paths from (select report_path, case when report_path is null or regexp_matches(report_path, '^reports/ui/') then null when contains(report_path,'/old/') then 'old report' when regexp_matches(report_path, '\.json$') then 'json outside ui' else 'other' end as reason from checks) where reason is not null group by 1",
    "p25_conditional_update": f"""
with k as (select region_key, text, human_edited, {_squeeze('text')} as t from regions)
select region_key, coalesce(text <> t, false) as changed, coalesce(human_edited,false) or coalesce(text <> t, false) as human_edited, case when coalesce(text <> t, false) then length(t) - length(text) else 0 end::bigint as growth from k""",
    "f01_norm": f"select doc_id, md5({_norm('text')}) as norm_md5 from documents",
    "f02_question_key": f"select item_id, trim(regexp_replace(regexp_replace({_norm('item_text')}, '[^\\p{{L}}\\p{{N}} ]+', '', 'g'), ' +', ' ', 'g')) as key from eval_items",
    "f03_codes": r"with k as (select region_key, regexp_extract_all(lower(text), '(?:^|[^\p{L}\p{N}])[eе] ?[0-9]+[a-dа-г]?[0-9]?') as m from regions), d as (select region_key, list_transform(m, lambda x: [regexp_extract(x, '[eе] ?([0-9]+)', 1), regexp_extract(x, '[eе] ?[0-9]+([a-dа-г]?)$', 1)]) as d from k), o as (select region_key, list_transform(list_filter(d, lambda x: length(x[1]) between 3 and 4), lambda x: 'е' || x[1] || translate(x[2], 'abcd', 'абвг')) as c from d) select region_key, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), '|') as codes from o where len(c) > 0",
    "f05_words": "select region_key, len(list_distinct(list_filter(regexp_extract_all(translate(lower(text), 'ё', 'е'), '[\\p{L}\\p{N}]+'), lambda w: length(w) >= 3)))::bigint as n_words from regions where text is not null",
    "f07_digit_runs": r"select * from (select doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '[0-9][0-9 ]*[0-9]|[0-9]'), lambda r: replace(r, ' ', '')), lambda r: length(r) >= 4), '|') as runs from documents) where runs <> ''",
    "f09_fold": "select doc_id, md5(translate(text, 'abcehkmoptxyABCEHKMOPTXY', 'авсенкмортхуАВСЕНКМОРТХУ')) as folded_md5, regexp_matches(text, '[а-яё]') and regexp_matches(text, '[a-z]') as both_scripts from documents",
    "f18_times": "select id, loaded_at, coalesce(try_strptime(substr(ts,1,19), '%Y-%m-%d %H:%M:%S'), try_strptime(substr(ts,1,19), '%Y-%m-%dT%H:%M:%S')) as at, round(seconds / 60, 1) as minutes from checks",
    "f21_hash": "select doc_id, substr(sha256(coalesce(source,'') || chr(31) || text), 1, 16) as key from documents where text is not null",
    "f22_ean13": """
select o_orderkey, p || ((10 - list_sum(list_transform(range(1, 13), lambda i: substr(p, i, 1)::int * case when i % 2 = 1 then 1 else 3 end)) % 10) % 10)::int::varchar as ean
from (select o_orderkey, lpad(o_orderkey::varchar, 12, '0') as p from orders)""",
    "f14_energy": r"""
with n as (select region_key, try_cast(replace(nullif(regexp_extract(text, 'белки ([0-9]+(?:,[0-9]+)?) г', 1), ''), ',', '.') as double) as protein,
 try_cast(replace(nullif(regexp_extract(text, 'жиры ([0-9]+(?:,[0-9]+)?) г', 1), ''), ',', '.') as double) as fat,
 try_cast(replace(nullif(regexp_extract(text, 'углеводы ([0-9]+(?:,[0-9]+)?) г', 1), ''), ',', '.') as double) as carbs,
 try_cast(replace(nullif(regexp_extract(text, '([0-9]+(?:,[0-9]+)?) ккал', 1), ''), ',', '.') as double) as kcal from regions where text like '%белки%'), k as (select *, round(4*protein + 9*fat + 4*carbs, 1) as counted from n)
select region_key, counted, kcal, round(abs(kcal - counted) / nullif(counted, 0.0) * 100, 1) as deviation from k""",
    "f28_json": """
select id, loaded_at, coalesce(array_to_string(list_sort(case when json_valid(categories) then from_json(categories, '["varchar"]') end), '|'), '') as categories,
 case when tokens_json is null then null else coalesce(list_sum(list_transform(json_keys(tokens_json), lambda k: cast(json_extract(tokens_json, '$."' || k || '".prompt') as bigint))), 0)::bigint end as prompt,
 array_to_string(list_sort(json_keys(tokens_json)), '|') as models from checks""",
}
