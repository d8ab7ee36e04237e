"""Queries of extractions, predicates and joins over labels, citations and the journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as N
from ..functions import text as T
from ..operators import boxes as B
from ..operators import evaluation as E
from ..operators import segments as S
from ..sources.tables import table
from . import layout as L

c = F.col
_UNIT = r"([0-9]+(?:[.,][0-9]+)?) ?(°C|%|мг|мм)"


def p05_address(spark: SparkSession, d: str) -> DataFrame:
    """The address of each chunk as a person writes it."""
    chunks = table(spark, d, "chunks", ["chunk_id", "regulation_id", "subsection", "clause", "appendix", "part"]).distinct()
    parts = [
        c("regulation_id"),
        F.when(c("appendix").isNotNull(), F.concat(F.lit("приложение "), c("appendix"))),
        F.when(c("subsection").isNotNull(), F.concat(F.lit("раздел "), F.regexp_replace("subsection", r"\.$", ""))),
        F.when(c("clause").isNotNull(), F.concat(F.lit("пункт "), c("clause"))),
        F.when(c("part").isNotNull(), F.concat(F.lit("часть "), c("part").cast("string"))),
    ]
    return chunks.select("chunk_id", F.concat_ws(", ", *parts).alias("address"))


def p15_retry(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of each read that must be read again: without text, or with nothing but marks of what could not be read."""
    bare = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\[[^\]]*\]|[…?.]", ""))
    regions = table(spark, d, "regions", ["source_sha256", "read_no", "region_key", "text"])
    return regions.groupBy("source_sha256", "read_no").agg(F.count("*").alias("n"), F.count_if(bare == "").alias("retry")).where("retry > 0")


def p17_partial(spark: SparkSession, d: str) -> DataFrame:
    """Later reads whose words are mostly not those of the first read, and how many of their blocks are so."""
    pairs = L._pairs_of_reads(spark, d)
    a, b = T.words(c("a")), T.words(c("b"))
    sizes = pairs.select("source_sha256", "read_no", F.size(a).alias("n"), F.size(F.array_except(a, b)).alias("lost"))
    per = sizes.groupBy("source_sha256", "read_no").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"), F.count_if((c("n") > 0) & (c("lost") > 0.5 * c("n"))).alias("partial_blocks"))
    coverage = F.round(1 - c("lost") / F.nullif(c("n"), F.lit(0)), 4)
    return per.select("source_sha256", "read_no", coverage.alias("coverage"), F.coalesce(coverage < 0.6, F.lit(False)).alias("partial"), "partial_blocks")


def p20_fresh(spark: SparkSession, d: str) -> DataFrame:
    """Whether what was made of each source's documents by the end of 2024 is still fresh: seals of the rows then and now."""
    docs = table(spark, d, "documents", ["doc_id", "source", "text", "loaded_at"])
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", c("doc_id").cast("string"), F.coalesce("text", F.lit("")))), 1, 15), 16, 10).cast("bigint")
    then = c("loaded_at") < F.expr("timestamp_ntz'2025-01-01 00:00:00'")
    seals = docs.groupBy("source").agg(F.count_if(then).alias("n_then"), F.count("*").alias("n_now"), F.bit_xor(F.when(then, digest)).alias("seal_then"), F.bit_xor(digest).alias("seal_now"))
    return seals.select("source", "n_then", "n_now", (c("seal_then").eqNullSafe(c("seal_now")) & (c("n_then") == c("n_now"))).alias("fresh"))


def j10_units(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with a unit in documents that no chunk of the regulation which they name has."""
    number = lambda text: F.transform(F.regexp_extract_all(text, F.lit(_UNIT), F.lit(0)), lambda x: F.translate(x, ", ", "."))
    docs = table(spark, d, "documents", ["doc_id", "regulation_id", "text"]).where("regulation_id is not null")
    asked = docs.select("doc_id", "regulation_id", F.explode(F.array_distinct(number(c("text")))).alias("number"))
    have = table(spark, d, "chunks", ["regulation_id", "text"]).select("regulation_id", F.explode(number(c("text"))).alias("number")).distinct()
    return asked.join(have, ["regulation_id", "number"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("number").alias("first"))


def j12_kept(spark: SparkSession, d: str) -> DataFrame:
    """Regions of each kind in a read, without those that an earlier kept one covers by half or more."""
    boxes = L._boxes(spark, d).select("source_sha256", "read_no", "kind", c("region_key").alias("box_id"), *B.CORNERS)
    dropped = B.dropped_greedily(B.overlapping(boxes, ["source_sha256", "read_no", "kind"], 0.5), ["source_sha256", "read_no", "kind"])
    return boxes.select("source_sha256", "read_no", "box_id").distinct().join(dropped, "box_id", "left_anti").groupBy("source_sha256", "read_no").agg(F.count("*").alias("n_kept"), F.sum("box_id").alias("keys"))


def j24_reports(spark: SparkSession, d: str) -> DataFrame:
    """Checks with the check that the base name of their report names, absent ones too."""
    checks = table(spark, d, "checks", ["id", "report_path"]).distinct()
    named = F.regexp_extract(T.file_name(c("report_path")), r"(\d+)", 1).try_cast("bigint")
    known = checks.select(c("id").alias("named")).distinct().withColumn("there", F.lit(True))
    return checks.withColumn("named", named).join(known, "named", "left").select("id", "report_path", "named", F.coalesce("there", F.lit(False)).alias("there"))


def j25_fill(spark: SparkSession, d: str) -> DataFrame:
    """Aspects that checks have no verdict for: each gets a row that a person must fill, counted by aspect."""
    checks = table(spark, d, "checks", ["id"]).distinct().select(c("id").alias("check_id"))
    aspects = table(spark, d, "aspects", ["aspect_id"])  # a fixed list
    wanted = checks.withColumn("all", F.lit(1)).join(F.broadcast(aspects.withColumn("all", F.lit(1))), "all").drop("all")
    have = table(spark, d, "verdicts", ["check_id", "aspect_id"]).where("check_id is not null").distinct()
    return wanted.join(have, ["check_id", "aspect_id"], "left_anti").groupBy("aspect_id").agg(F.lit("manual").alias("status"), F.count("*").alias("n"))


def x05_subset(spark: SparkSession, d: str) -> DataFrame:
    """Checks all of whose categories are among those of at least twenty checks."""
    checks = table(spark, d, "checks", ["id", "categories"]).distinct().withColumn("list", F.from_json("categories", "array<string>"))
    common = checks.select(F.explode("list").alias("x")).groupBy("x").agg(F.count("*").alias("n")).where("n >= 20")
    known = common.agg(F.sort_array(F.collect_set("x")).alias("known"))  # one row: the categories are a fixed list
    return checks.join(F.broadcast(known)).select("id", (F.size(F.array_except(F.coalesce("list", F.array().cast("array<string>")), "known")) == 0).alias("subset"))


def o06_corpus_order(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each clause in the order of the corpus: by document and position, not by id as text."""
    chunks = table(spark, d, "chunks", ["chunk_id", "regulation_id", "clause"]).where("clause is not null").distinct()
    place = F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("bigint")
    rows = chunks.select("regulation_id", "clause", place.alias("place"), "chunk_id")
    return S.Ordered(rows, ["regulation_id", "clause"], ["place"]).running(F.lit(1), "number").done().select("regulation_id", "clause", "chunk_id", "number")


def o08_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of each read from top to bottom and left to right."""
    boxes = L._boxes(spark, d).withColumn("y", F.round("y0", 2)).withColumn("x", F.round("x0", 2)).select("source_sha256", "read_no", "y", "x", "region_key").distinct()
    order = Window.partitionBy("source_sha256", "read_no").orderBy("y", "x", "region_key")
    return boxes.withColumn("place", F.row_number().over(order)).select("source_sha256", "read_no", "region_key", "place")


def f04_code_boundary(spark: SparkSession, d: str) -> DataFrame:
    """For each additive code the regions that name it in either alphabet with no further digit behind it."""
    regions = table(spark, d, "regions", ["region_key", "text"])
    codes = regions.select(F.explode(T.additive_codes(c("text"))).alias("code")).distinct()
    named = regions.select("region_key", F.col("text"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[eе] ?([0-9]{3,4})"), F.lit(1)))).alias("digits"))
    found = named.join(codes.withColumn("digits", F.regexp_extract("code", r"([0-9]+)", 1)), "digits").where(F.regexp_like(F.lower("text"), N.code_pattern(c("code"))))
    return found.groupBy("code").agg(F.count_distinct("region_key").alias("n"))


def f06_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Words of blocks outside the lines that describe signs and pictures."""
    lines = F.filter(S.lines_of(c("text")), lambda x: ~F.lower(x).rlike("знак|логотип|рисун|эмблем"))
    return table(spark, d, "regions", ["region_key", "text"]).where("text is not null").select("region_key", F.size(T.words(F.array_join(lines, "\n"), 5)).cast("bigint").alias("n_words"))


def f12_nutrition(spark: SparkSession, d: str) -> DataFrame:
    """Protein, fat, carbohydrate, kcal and kJ of labels, and how far the stated energy is from that of the parts."""
    regions = table(spark, d, "regions", ["region_key", "text"]).where("lower(text) rlike 'белки|жиры|углеводы|ккал|кдж'")
    return N.nutrition(regions, "text").drop("text")


def f17_units(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with their units in each chunk, in order."""
    return L._chunks(spark, d).select("chunk_id", F.array_join(F.regexp_extract_all("text", F.lit(_UNIT), F.lit(0)), "|").alias("numbers")).where("numbers <> ''")


def f22_ean_valid(spark: SparkSession, d: str) -> DataFrame:
    """Runs of thirteen digits in documents and regions with whether their check digit is right."""
    text = table(spark, d, "regions", ["text"]).unionByName(table(spark, d, "documents", ["text"]))
    runs = text.select(F.explode(T.digit_runs(c("text"), 13)).alias("digits")).where("length(digits) = 13")
    return runs.groupBy("digits").agg(F.count("*").alias("n")).select("digits", "n", (F.substring("digits", 13, 1) == T.ean13_digit(F.substring("digits", 1, 12)).cast("string")).alias("valid"))


def f25_halving(spark: SparkSession, d: str) -> DataFrame:
    """Regions wider than a tenth cut in halves that overlap by a hundredth until none is wider."""
    boxes = L._boxes(spark, d).distinct()
    pieces = B.halved(c("x0"), c("x1"), 0.1, 0.01)
    return boxes.where("x1 > x0").select("region_key", F.posexplode(pieces).alias("piece", "p")).select("region_key", "piece", F.round("p.a", 6).alias("x0"), F.round("p.b", 6).alias("x1"))


def f31_answers(spark: SparkSession, d: str) -> DataFrame:
    """Votes written as JSON: the first two that are texts, trimmed; what is no list is a problem."""
    votes = table(spark, d, "verdicts", ["id", "votes", "loaded_at"]).where("votes is not null")
    listed = F.from_json("votes", "array<string>")
    texts = F.slice(F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != ""), 1, 2)
    return votes.select("id", "loaded_at", F.array_join(texts, "|").alias("answers"), F.when(listed.isNull(), "no list").alias("problem"))


def c07_reguard(spark: SparkSession, d: str) -> DataFrame:
    """Statuses of later reads found anew from the words; what a person edited or confirmed keeps its own."""
    fresh = L.c05_assess(spark, d).select("source_sha256", "read_no", "region_id", c("status").alias("found"))
    rows = table(spark, d, "regions", ["source_sha256", "read_no", "region_id", "region_key", "status", "human_edited", "human_confirmed"]).where("read_no > 1")
    human = F.coalesce("human_edited", F.lit(False)) | F.coalesce("human_confirmed", F.lit(False))
    joined = rows.join(fresh, ["source_sha256", "read_no", "region_id"], "left")
    return joined.select("region_key", F.when(human | c("found").isNull(), c("status")).otherwise(c("found")).alias("status"), human.alias("by_human")).distinct()


def s22_ground_truth(spark: SparkSession, d: str) -> DataFrame:
    """Held-out questions as they are loaded: the last row of an id, its seal checked, and what is wrong with it."""
    items = table(spark, d, "eval_items", ["item_id", "item_text", "lang", "category", "style"])
    return E.ground_truth(items, "item_id", ["item_text", "lang", "category", "style"], {"no text": F.coalesce(F.trim("item_text"), F.lit("")) == "", "no language": ~F.coalesce("lang", F.lit("")).isin("ru", "uk", "kk", "en", "de", "fr", "es")})


def t05_appendix(spark: SparkSession, d: str) -> DataFrame:
    """Whether a chunk is cut by its clauses (three numbered lines or more, not too many tiny ones) or by windows of rows."""
    lines = F.filter(S.lines_of(c("text")), lambda x: F.length(F.trim(x)) > 0)
    clauses, tiny = F.filter(lines, lambda x: x.rlike(r"^(\d+|[а-яё])[.)] ")), F.filter(lines, lambda x: F.length(x) < 20)
    share = F.size(tiny) / F.nullif(F.size(lines), F.lit(0))
    return L._chunks(spark, d).select("chunk_id", F.size(clauses).cast("bigint").alias("n_clauses"), F.round(share, 4).alias("tiny"), F.when((F.size(clauses) >= 3) & (share <= 0.5), "clauses").otherwise("windows").alias("form"))


def t01_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents without blocks that run from a heading of notes to the next blank line, within ten lines."""
    kept = S.drop_blocks(S.lines_of(c("text")), r"^(Примечани|Note|Remarque|Hinweis)", r"^\s*$", 10)
    docs = table(spark, d, "documents", ["doc_id", "text"]).where("text is not null")
    return docs.select("doc_id", F.size(S.lines_of(c("text"))).cast("bigint").alias("n_lines"), F.size(kept).cast("bigint").alias("n_kept"))


QUERIES = {
    f.__name__: f
    for f in (p05_address, p15_retry, p17_partial, p20_fresh, j10_units, j12_kept, j24_reports, j25_fill, x05_subset, o06_corpus_order, o08_reading_order, f04_code_boundary, f06_candidates, f12_nutrition, f17_units, f22_ean_valid, f25_halving)
    + (f31_answers, c07_reguard, s22_ground_truth, t05_appendix, t01_blocks)
}
_NUM = r"[0-9]+(?:[.,][0-9]+)?"
_UNITS = "list_transform(regexp_extract_all(text, '([0-9]+(?:[.,][0-9]+)?) ?(°C|%|мг|мм)', 0), lambda x: translate(replace(x, ' ', ''), ',', '.'))"


def _number(pattern: str, group: int = 1) -> str:
    return f"try_cast(replace(nullif(regexp_extract(t, '{pattern}', {group}), ''), ',', '.') as double)"


_FORWARD = ", ".join(f"{_number(N.forward(x))} as f{i}" for i, x in enumerate(N.PARTS))
_BACKWARD = ", ".join(f"{_number(N.backward(x))} as b{i}" for i, x in enumerate(N.PARTS))
_GIVEN = lambda p: " + ".join(f"({p}{i} is not null)::int" for i in range(3))
_PICKED = ", ".join(f"case when {_GIVEN('b')} > {_GIVEN('f')} then b{i} else f{i} end as p{i}" for i in range(3))
SQL = {
    "p05_address": "select distinct chunk_id, concat_ws(', ', regulation_id, case when appendix is not null then 'приложение ' || appendix end, case when subsection is not null then 'раздел ' || regexp_replace(subsection, '[.]$', '') end, case when clause is not null then 'пункт ' || clause end, case when part is not null then 'часть ' || part end) as address from (select distinct chunk_id, regulation_id, subsection, clause, appendix, part from chunks)",
    "p15_retry": r"select source_sha256, read_no, count(*) as n, count(*) filter (where trim(regexp_replace(coalesce(text, ''), '\[[^\]]*\]|[…?.]', '', 'g')) = '') as retry from regions group by 1, 2 having retry > 0",
    "p17_partial": f"with {L._PAIRS}, s as (select source_sha256, read_no, len(wa) as n, len(list_filter(wa, lambda w: not list_contains(wb, w))) as lost from p), k as (select source_sha256, read_no, sum(n) as n, sum(lost) as lost, count(*) filter (where n > 0 and lost > 0.5 * n) as partial_blocks from s group by 1, 2) select source_sha256, read_no, round(1 - lost / nullif(n, 0), 4) as coverage, coalesce(round(1 - lost / nullif(n, 0), 4) < 0.6, false) as partial, partial_blocks from k",
    "p20_fresh": "with k as (select source, loaded_at < timestamp '2025-01-01' as early, ('0x' || substr(md5(doc_id::varchar || '|' || coalesce(text, '')), 1, 15))::bigint as digest from documents) select source, count(*) filter (where early) as n_then, count(*) as n_now, bit_xor(digest) filter (where early) is not distinct from bit_xor(digest) and count(*) filter (where early) = count(*) as fresh from k group by 1",
    "j10_units": f"with a as (select distinct doc_id, regulation_id, unnest({_UNITS}) as number from documents where regulation_id is not null), b as (select distinct regulation_id, unnest({_UNITS}) as number from chunks) select doc_id, count(*) as n, min(number) as first from a anti join b using (regulation_id, number) group by 1",
    "j24_reports": r"with k as (select distinct id, report_path from checks), n as (select *, try_cast(nullif(regexp_extract(regexp_extract(report_path, '[^/]+$', 0), '(\d+)', 1), '') as bigint) as named from k) select id, report_path, named, coalesce(named in (select id from k), false) as there from n",
    "j25_fill": "select aspect_id, 'manual' as status, count(*) as n from (select distinct id as check_id from checks) cross join (select aspect_id from aspects) anti join (select distinct check_id, aspect_id from verdicts where check_id is not null) using (check_id, aspect_id) group by 1",
    "x05_subset": """with k as (select distinct id, categories from checks), l as (select id, categories, case when json_valid(categories) then from_json(categories, '["varchar"]') else [] end as list from k), n as (select coalesce(list(x), []) as known from (select x from (select unnest(list) as x from l) group by 1 having count(*) >= 20)) select id, len(list_filter(coalesce(list, []), lambda y: not list_contains(known, y))) = 0 as subset from l, n""",
    "o06_corpus_order": r"select regulation_id, clause, chunk_id, row_number() over (partition by regulation_id, clause order by regexp_extract(chunk_id, '(\d+)$', 1)::bigint, chunk_id) as number from (select distinct chunk_id, regulation_id, clause from chunks where clause is not null)",
    "o08_reading_order": f"select source_sha256, read_no, region_key, row_number() over (partition by source_sha256, read_no order by y, x, region_key)::int as place from (select distinct source_sha256, read_no, region_key, round(y0, 2) as y, round(x0, 2) as x from {L._BOX})",
    "f06_candidates": r"select region_key, len(list_distinct(list_filter(regexp_extract_all(translate(lower(array_to_string(list_filter(string_split(text, chr(10)), lambda l: not regexp_matches(lower(l), 'знак|логотип|рисун|эмблем')), chr(10))), 'ё', 'е'), '[\p{L}\p{N}]+'), lambda w: length(w) >= 5)))::bigint as n_words from regions where text is not null",
    "f12_nutrition": f"""
with r as (select region_key, lower(text) as t from regions where regexp_matches(lower(text), 'белки|жиры|углеводы|ккал|кдж')),
n as (select region_key, {_FORWARD}, {_BACKWARD}, {_number(N.ENERGY[0], 1)} as kj_a, {_number(N.ENERGY[0], 2)} as kcal_a, {_number(N.ENERGY[1], 1)} as kcal_b, {_number(N.ENERGY[1], 2)} as kj_b, {_number(N.ENERGY[2], 1)} as kcal_c from r),
e as (select region_key, {_PICKED}, case when kj_a is not null then kcal_a when kcal_b is not null then kcal_b else kcal_c end as c0, case when kj_a is not null then kj_a when kcal_b is not null then kj_b end as j0 from n),
s as (select *, case when abs(c0 / nullif(j0, 0) - 4.184) <= 0.6 and not coalesce(abs(j0 / nullif(c0, 0) - 4.184) <= 0.6, false) then true else false end as turned from e),
k as (select region_key, p0 as protein, p1 as fat, p2 as carbs, case when turned then j0 else c0 end as kcal, case when turned then c0 else j0 end as kj, round(4 * p0 + 9 * p1 + 4 * p2, 1) as kcal_counted, round(17 * p0 + 37 * p1 + 17 * p2, 1) as kj_counted from s)
select *, round(abs(kcal - kcal_counted) / nullif(kcal_counted, 0.0) * 100, 1) as kcal_off, round(abs(kj - kj_counted) / nullif(kj_counted, 0.0) * 100, 1) as kj_off from k""",
    "f17_units": f"select * from (select chunk_id, array_to_string(regexp_extract_all(text, '([0-9]+(?:[.,][0-9]+)?) ?(°C|%|мг|мм)', 0), '|') as numbers from {L._CH}) where numbers <> ''",
    "f22_ean_valid": "with t as (select text from regions union all select text from documents), r as (select unnest(list_transform(regexp_extract_all(text, '[0-9][0-9 ]*[0-9]|[0-9]'), lambda r: replace(r, ' ', ''))) as digits from t) select digits, count(*) as n, substr(digits, 13, 1) = ((10 - list_sum(list_transform(range(1, 13), lambda i: substr(digits, i, 1)::int * case when i % 2 = 1 then 1 else 3 end)) % 10) % 10)::int::varchar as valid from r where length(digits) = 13 group by 1",
    "f25_halving": f"""
with recursive h(region_key, path, a, b) as (select distinct region_key, '', x0, x1 from {L._BOX} where x1 > x0
 union all select region_key, path || side, case when side = '0' then a else b - (b - a + 0.01) / 2 end, case when side = '0' then a + (b - a + 0.01) / 2 else b end from h, (values ('0'), ('1')) s(side) where b - a > 0.1 + 1e-9)
select region_key, (row_number() over (partition by region_key order by path) - 1)::int as piece, round(a, 6) as x0, round(b, 6) as x1 from h where b - a <= 0.1 + 1e-9""",
    "f31_answers": """select id, loaded_at, case when l is null then null else array_to_string(list_filter(list_transform(l, lambda x: trim(x)), lambda x: x is not null and x <> '')[1:2], '|') end as answers, case when l is null then 'no list' end as problem from (select *, case when json_valid(votes) and json_type(votes) = 'ARRAY' then from_json(votes, '["varchar"]') end as l from verdicts where votes is not null)""",
    "c07_reguard": f"with {L._PAIRS}, s as ({L._ASSESS}), g as (select source_sha256, read_no, region_id, case when reason <> '' then 'manual' else 'read' end as found from s) select distinct region_key, case when coalesce(human_edited, false) or coalesce(human_confirmed, false) or found is null then status else found end as status, coalesce(human_edited, false) or coalesce(human_confirmed, false) as by_human from (select * from regions where read_no > 1) left join g using (source_sha256, read_no, region_id)",
    "s22_ground_truth": "select item_id, concat_ws('|', case when coalesce(trim(item_text), '') = '' then 'no text' end, case when coalesce(lang, '') not in ('ru', 'uk', 'kk', 'en', 'de', 'fr', 'es') then 'no language' end) as problems, substr(sha256(concat_ws(chr(31), item_id::varchar, coalesce(item_text, ''), coalesce(lang, ''), coalesce(category, ''), coalesce(style, ''))), 1, 16) as seal from eval_items",
    "t05_appendix": rf"with k as (select chunk_id, list_filter(string_split(text, chr(10)), lambda l: length(trim(l)) > 0) as l from {L._CH}), n as (select chunk_id, len(list_filter(l, lambda x: regexp_matches(x, '^(\d+|[а-яё])[.)] '))) as n_clauses, len(list_filter(l, lambda x: length(x) < 20)) / nullif(len(l), 0)::double as share from k) select chunk_id, n_clauses::bigint as n_clauses, round(share, 4) as tiny, case when n_clauses >= 3 and share <= 0.5 then 'clauses' else 'windows' end as form from n",
}
