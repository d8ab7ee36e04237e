"""Queries of segmentation, of guards on read texts, and of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import boxes as B
from ..operators import guards as G
from ..operators import segments as S
from ..sources.tables import table

c = F.col
READ = ["source_sha256", "read_no", "region_id"]
RULES = {"substrings": ["Архивная копия"], "patterns": [r"Приложение [0-9]+", r"[0-9]+$"]}


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks", ["chunk_id", "text"]).distinct()


def t01_clean_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines kept and dropped by rule, for each chunk."""
    kept, dropped = S.clean_lines(S.lines_of(c("text")), **RULES)
    return _chunks(spark, d).select("chunk_id", F.size(kept).cast("bigint").alias("kept"), F.size(dropped).cast("bigint").alias("dropped"), F.length(F.array_join(kept, "\n")).cast("bigint").alias("n_chars"))


def s08_audit_split(spark: SparkSession, d: str) -> DataFrame:
    """Every dropped line with the rule that dropped it: the audit of the cleaner."""
    _, dropped = S.clean_lines(S.lines_of(c("text")), **RULES)
    return _chunks(spark, d).select("chunk_id", F.explode(dropped).alias("x")).groupBy(c("x.rule").alias("rule")).agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("n_chunks"))


def t02_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the lines of each chunk at its list entries."""
    rows = S.lines(_chunks(spark, d), "chunk_id", "text")
    return S.segment_ids(rows, "chunk_id", "line_no", c("line").rlike(r"^[а-яё]\) ")).groupBy("chunk_id", "segment").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def t03_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The numbered clause that each chunk of a document stands under, and the length of the chunk before."""
    chunks = table(spark, d, "chunks", ["chunk_id", "text"]).distinct().withColumn("document", F.regexp_extract("chunk_id", "^(.*):", 1)).withColumn("n_chars", F.length("text").cast("bigint"))
    number = F.nullif(F.regexp_extract("text", r"^(\d+)\. ", 1), F.lit(""))
    rows = chunks.select("document", "chunk_id", number.alias("number"), "n_chars")
    return S.Ordered(rows, ["document"], ["chunk_id"]).carry(c("number"), "clause").previous("n_chars", "n_before").done().select("chunk_id", "clause", "n_before")


def t09_structure(spark: SparkSession, d: str) -> DataFrame:
    """Every line of the documents with the clause, the list entry and the unit it belongs to.

    A numbered line opens a clause and ends the entry before it; a lettered line opens an entry of its clause.
    """
    chunks = table(spark, d, "chunks", ["chunk_id", "is_table", "text"]).where("not is_table").select("chunk_id", "text").distinct()
    lines = S.lines(chunks, "chunk_id", "text").withColumn("document", F.regexp_extract("chunk_id", "^(.*):", 1))
    clause = F.nullif(F.regexp_extract("line", r"^(\d+)\. ", 1), F.lit(""))
    entry = F.nullif(F.regexp_extract("line", r"^([а-яё])\) ", 1), F.lit(""))
    rows = lines.select("document", "chunk_id", "line_no", clause.alias("opens"), entry.alias("opens_entry"), F.length("line").alias("n_chars"))
    # an entry is carried as a place in its clause: what a clause opens starts with none
    marked = rows.withColumn("mark", F.when(c("opens").isNotNull(), F.lit("")).otherwise(c("opens_entry")))
    ordered = S.Ordered(marked, ["document"], ["chunk_id", "line_no"]).carry(c("opens"), "clause").carry(c("mark"), "entry")
    ordered = ordered.running(F.when(c("opens").isNotNull() | c("opens_entry").isNotNull(), 1).otherwise(0), "unit")
    return ordered.done().groupBy("document", "unit").agg(F.max("clause").alias("clause"), F.nullif(F.max("entry"), F.lit("")).alias("entry"), F.count("*").alias("n_lines"), F.sum("n_chars").alias("n_chars"))


def a23_parse_counters(spark: SparkSession, d: str) -> DataFrame:
    """Per document: chunks, tables, lines, lines dropped by a rule, longest chunk, small chunks."""
    chunks = table(spark, d, "chunks", ["chunk_id", "is_table", "text"]).distinct()
    kept, dropped = S.clean_lines(S.lines_of(c("text")), **RULES)
    per = chunks.select(F.regexp_extract("chunk_id", "^(.*):", 1).alias("document"), "is_table", F.size(kept).alias("kept"), F.size(dropped).alias("dropped"), F.length("text").alias("n"))
    return per.groupBy("document").agg(
        F.count("*").alias("n_chunks"), F.count_if("is_table").alias("n_tables"), F.sum("kept").alias("n_lines"), F.sum("dropped").alias("n_dropped"), F.max("n").cast("bigint").alias("longest"), F.count_if(c("n") < 120).alias("small")
    )


def t04_pack_lines(spark: SparkSession, d: str) -> DataFrame:
    """Whole lines packed into parts of at most 500 characters."""
    parts = S.pack(S.lines_of(c("text")), 500)
    return _chunks(spark, d).select("chunk_id", F.posexplode(parts).alias("part", "text")).select("chunk_id", "part", F.length("text").alias("n_chars"), F.md5(c("text").cast("binary")).alias("md5"))


def t05_windows(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows of 30 lines, each with the head of six lines."""
    docs = table(spark, d, "documents", ["doc_id", "text"]).where("text is not null")
    w = docs.select("doc_id", F.explode(S.windows(S.lines_of(c("text")))).alias("w"))
    return w.select("doc_id", c("w.window_no").cast("bigint").alias("window_no"), F.size("w.rows").cast("bigint").alias("n_lines"), F.length(F.array_join("w.rows", "\n")).cast("bigint").alias("n_chars"))


def t06_positional_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "regions", ["region_key", "source_sha256"]).distinct()
    return S.positional_ids(docs.withColumn("stem", F.substring("source_sha256", 1, 8)), "stem", ["source_sha256", "region_key"]).select("region_key", "chunk_id")


def t07_tail_sentence(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", T.tail_sentence(c("text")).alias("tail"))


def t08_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of chunks of one clause whose part numbers go on."""
    address = ["section", "subsection", "clause", "appendix"]
    chunks = table(spark, d, "chunks", ["chunk_id", "regulation_id", "part", *address]).distinct()
    rows = chunks.select("regulation_id", "chunk_id", F.struct("part", F.to_json(F.struct(*address)).alias("address")).alias("here"))
    ordered = S.Ordered(rows, ["regulation_id"], ["chunk_id"]).previous("here", "before")
    runs = S.islands(ordered, (c("here.part") == c("before.part") + 1) & (c("here.address") == c("before.address")))
    return runs.groupBy("regulation_id", "island").agg(F.min("chunk_id").alias("first"), F.max("chunk_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("island")


def t08_event_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal event types of a user."""
    events = table(spark, d, "events", ["user_id", "ts", "event_id", "event_type"])
    runs = S.islands(S.Ordered(events, ["user_id"], ["ts", "event_id"]).previous("event_type", "before"), c("event_type") == c("before"))
    return runs.groupBy("user_id", "island").agg(F.min("event_id").alias("first"), F.count("*").alias("n")).drop("island")


def _pairs_of_reads(spark: SparkSession, d: str) -> DataFrame:
    """Texts of one block in the first and in each later read of its layout, the first row of each.

    A block that only one of the two reads has comes out with an empty text on the other side; so does every block
    of a first read whose later read has no text at all. ``read_no`` is the later read.
    """
    rows = table(spark, d, "regions", ["source_sha256", "read_no", "region_id", "text", "region_key"])
    later = rows.where("read_no > 1").select("source_sha256", "read_no").distinct()
    one = rows.where("text is not null and text <> ''").groupBy(*READ).agg(F.min_by("text", "region_key").alias("text"))
    clean = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", " ")
    a = one.where("read_no = 1").select("source_sha256", "region_id", clean.alias("a")).join(later, "source_sha256")
    b = one.where("read_no > 1").select(*READ, clean.alias("b"))
    return a.join(b, READ, "full").select(*READ, F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b"))


def j15_word_anti(spark: SparkSession, d: str) -> DataFrame:
    """Words of the first read that a later one lacks, and the share that is there."""
    a, b = T.words(c("a")), T.words(c("b"))
    missing = G.missing_words(a, b, F.regexp_replace(F.translate("b", "ё", "е"), " ", ""))
    return _pairs_of_reads(spark, d).select(*READ, F.array_join(missing, "|").alias("missing"), F.round(G.coverage(missing, a), 4).alias("coverage"))


def j16_invented(spark: SparkSession, d: str) -> DataFrame:
    """Words of a later read that the first lacks, as often as they stand there."""
    invented = G.invented_words(T.word_list(c("b")), T.words(c("a")), F.regexp_replace(F.translate("a", "ё", "е"), " ", ""))
    return _pairs_of_reads(spark, d).select(*READ, F.array_join(invented, "|").alias("invented"), F.round(F.size(invented) / F.nullif(F.size(T.word_list(c("b"))), F.lit(0)), 4).alias("mismatch"))


def j30_diff(spark: SparkSession, d: str) -> DataFrame:
    """Both differences and the common part of the words of two reads."""
    a, b = T.words(c("a")), T.words(c("b"))
    pairs = _pairs_of_reads(spark, d)
    return pairs.select(*READ, F.size(F.array_except(a, b)).cast("bigint").alias("only_first"), F.size(F.array_except(b, a)).cast("bigint").alias("only_second"), F.size(F.array_intersect(a, b)).cast("bigint").alias("common"))


def _words_of_reads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Words of all alphabets, split at everything but letters, that only one of the two reads has."""
    pairs = _pairs_of_reads(spark, d).select("source_sha256", "read_no", F.regexp_replace("a", r"\P{L}", " ").alias("a"), F.regexp_replace("b", r"\P{L}", " ").alias("b"))
    both = lambda x, y: F.array_except(T.words(c(x), 5), T.words(c(y), 5))
    return pairs.select("source_sha256", "read_no", F.explode(both("a", "b")).alias("word")), pairs.select("source_sha256", "read_no", F.explode(both("b", "a")).alias("word"))


def j17_near_words(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of unmatched words of two reads that are at most two edits apart."""
    return G.near_pairs(*_words_of_reads(spark, d), ["source_sha256", "read_no"])


def j17_nearest(spark: SparkSession, d: str) -> DataFrame:
    return G.nearest(G.near_pairs(*_words_of_reads(spark, d), ["source_sha256", "read_no"]), ["source_sha256", "read_no"])


def j18_digit_runs(spark: SparkSession, d: str) -> DataFrame:
    """Digit runs of a later read that no run of the first one holds."""
    runs_a, runs_b = T.digit_runs(c("a"), 4), T.digit_runs(c("b"), 4)
    lost = F.filter(runs_b, lambda r: ~F.exists(runs_a, lambda x: x.contains(r)))
    return _pairs_of_reads(spark, d).select(*READ, F.array_join(lost, "|").alias("unconfirmed"))


def j23_markers(spark: SparkSession, d: str) -> DataFrame:
    """Words of the aspects' names that stand in the chunks: aspect, word, chunks."""
    names = table(spark, d, "aspects", ["aspect_id", "aspect_name"]).select("aspect_id", F.explode(T.words(c("aspect_name"), 5)).alias("word"))
    words = _chunks(spark, d).select("chunk_id", F.explode(T.words(c("text"), 5)).alias("word"))
    return words.join(names, "word").groupBy("aspect_id", "word").agg(F.count_distinct("chunk_id").alias("n_chunks"))


def j09_token_except(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with a unit in a chunk that its cited clause line does not have."""
    numbers = lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"([0-9]+(?:,[0-9]+)?) (?:мг|мм|%|°C)"), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit(".")))
    first_line = F.substring_index("text", "\n", 1)
    rest = F.array_except(numbers(c("text")), numbers(first_line))
    return _chunks(spark, d).select("chunk_id", F.array_join(F.sort_array(rest), "|").alias("numbers"))


def j08_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """Last sentences of chunks as citations of the chunk after theirs or, every third, of their own: absent, not word for word, or right."""
    place = F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("bigint")
    chunks = _chunks(spark, d).withColumn("document", F.regexp_extract("chunk_id", "^(.*):", 1)).withColumn("place", place)
    cited = chunks.select("document", c("chunk_id").alias("from_id"), (c("place") + F.when(c("place") % 3 == 0, 0).otherwise(1)).alias("place"), T.norm_text(T.tail_sentence(c("text"))).alias("quote"))
    whole = chunks.select("document", "place", c("chunk_id").alias("cited_id"), T.norm_text(c("text")).alias("whole"))
    problem = F.when(c("cited_id").isNull(), "absent").when(~F.coalesce(c("whole").contains(c("quote")), F.lit(False)), "not word for word")
    return cited.join(whole, ["document", "place"], "left").select("from_id", "cited_id", problem.alias("problem"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "regions", ["source_sha256", "read_no", "region_key", "kind", "x0", "y0", "x1", "y1"]).dropna(subset=B.CORNERS)


def f23_bbox(spark: SparkSession, d: str) -> DataFrame:
    """Boxes given in hundredths with swapped corners, brought back."""
    box = B.normalize(c("x1") * 100, c("y0") * 100, c("x0") * 100, c("y1") * 100)
    return _boxes(spark, d).select("region_key", *(F.round(box[x], 6).alias(x) for x in B.CORNERS))


def j11_box_join(spark: SparkSession, d: str) -> DataFrame:
    """Regions whose centre lies in a region of another read of the layout."""
    boxes = _boxes(spark, d)
    pairs = B.centre_join(boxes.withColumnRenamed("region_key", "outer_id"), boxes.withColumnRenamed("region_key", "inner_id"), ["source_sha256"])
    return pairs.where("outer_id <> inner_id").groupBy("source_sha256", "outer_id").agg(F.count("*").alias("n_inside"))


def j27_smallest_box(spark: SparkSession, d: str) -> DataFrame:
    """Of the regions that hold a region's centre the smallest one."""
    boxes = _boxes(spark, d)
    pairs = B.centre_join(boxes.withColumnRenamed("region_key", "outer_id"), boxes.withColumnRenamed("region_key", "inner_id"), ["source_sha256", "read_no"])
    return pairs.groupBy("inner_id").agg(F.min_by("outer_id", F.struct(F.round(B.area("a_"), 6), "outer_id")).alias("outer_id"))


def j12_iou_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Regions of one kind and layout that overlap by half or more."""
    boxes = _boxes(spark, d).select("source_sha256", "kind", c("region_key").alias("box_id"), *B.CORNERS)
    return B.overlapping(boxes, ["source_sha256", "kind"], 0.5)


def j13_merge_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Close regions of one read merged until nothing changes."""
    boxes = _boxes(spark, d).select("source_sha256", "read_no", c("region_key").alias("box_id"), *B.CORNERS)
    return B.merge_close(boxes, ["source_sha256", "read_no"], 0.008)


def c05_assess(spark: SparkSession, d: str) -> DataFrame:
    """Status and reasons of each block from its words, in the order of weight."""
    pairs = _pairs_of_reads(spark, d)
    a, b = T.words(c("a")), T.words(c("b"))
    missing = G.missing_words(a, b, F.regexp_replace(F.translate("b", "ё", "е"), " ", ""))
    invented = G.invented_words(b, a, F.regexp_replace(F.translate("a", "ё", "е"), " ", ""))
    reasons = F.array_compact(F.array(F.when(F.size(missing) > 3, F.lit("words missing")), F.when(F.size(invented) > 3, F.lit("words invented")), F.when(F.size(b) < 2, F.lit("hardly read"))))
    return pairs.select(*READ, F.when(F.size(reasons) > 0, "manual").otherwise("read").alias("status"), F.array_join(reasons, "; ").alias("reason"))


def c06_guards(spark: SparkSession, d: str) -> DataFrame:
    """Later reads of layouts in which more than a tenth of the blocks need a person."""
    status = c05_assess(spark, d)
    per = status.groupBy("source_sha256", "read_no").agg(F.count("*").alias("n"), F.count_if(c("status") == "manual").alias("manual"))
    return per.withColumn("partial", F.round(c("manual") / c("n"), 4) > 0.1)


def a24_barcodes(spark: SparkSession, d: str) -> DataFrame:
    """Digit runs of regions with the regions they stand in and a class by length."""
    runs = table(spark, d, "regions", ["region_key", "text"]).select("region_key", F.explode(F.array_distinct(T.digit_runs(c("text"), 4))).alias("digits"))
    kind = F.when(F.length("digits") == 13, "ean13").when(F.length("digits").isin(12, 14), "upc or case").when(F.length("digits") == 8, "ean8").otherwise("other")
    return runs.groupBy("digits", kind.alias("kind")).agg(F.count("*").alias("n"), F.min("region_key").alias("first"))


QUERIES = {
    f.__name__: f
    for f in (t01_clean_lines, s08_audit_split, t02_segments, t03_carry_forward, t09_structure, a23_parse_counters, t04_pack_lines, t05_windows, t06_positional_id, t07_tail_sentence, t08_islands, t08_event_runs, j15_word_anti, j16_invented, j30_diff, j17_near_words, j17_nearest, j18_digit_runs)
    + (j23_markers, j09_token_except, j08_verbatim, f23_bbox, j11_box_join, j27_smallest_box, j12_iou_dedup, j13_merge_boxes, c05_assess, c06_guards, a24_barcodes)
}
_CH = "(select distinct chunk_id, text from chunks)"
_SPACE = r"\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{1680}\x{85}\x{2028}\x{2029}\x0b"
_CLEAN = rf"(select chunk_id, x as line, case when contains(x, 'Архивная копия') then 'text Архивная копия' when regexp_matches(x, '^(?:Приложение [0-9]+)') then 'pattern Приложение [0-9]+' when regexp_matches(x, '^(?:[0-9]+$)') then 'pattern [0-9]+$' end as rule, n from (select chunk_id, n, regexp_replace(l, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') as x from (select chunk_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as n from {_CH})) where x <> '')"
_REGIONS = r"(select source_sha256, region_id, read_no, regexp_replace(lower(arg_min(text, region_key)), '[^\p{L}\p{N}]', ' ', 'g') as t from regions where text is not null and text <> '' group by 1, 2, 3)"
_WL = "list_filter(regexp_extract_all(translate({}, 'ё', 'е'), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= {})"


def _w(x: str, n: int = 3, distinct: bool = True) -> str:
    return f"list_distinct({_WL.format(x, n)})" if distinct else _WL.format(x, n)


_PAIRS = f"""r as (select * from {_REGIONS}), later as (select distinct source_sha256, read_no from regions where read_no > 1),
x as (select r.source_sha256, later.read_no, r.region_id, r.t from r join later using (source_sha256) where r.read_no = 1), y as (select * from r where read_no > 1),
z as (select source_sha256, read_no, region_id, coalesce(x.t, '') as a, coalesce(y.t, '') as b from x full join y using (source_sha256, read_no, region_id)),
p as (select source_sha256, read_no, region_id, a, b, {_w('a')} as wa, {_w('b')} as wb, {_w('b', 3, False)} as lb, replace(translate(a, 'ё', 'е'), ' ', '') as sa, replace(translate(b, 'ё', 'е'), ' ', '') as sb from z)"""
_MISSING = "list_sort(list_filter(wa, lambda w: not list_contains(wb, w) and not contains(sb, w)))"
_BOX = "(select * from regions where x0 is not null and y0 is not null and x1 is not null and y1 is not null)"
_IN = "(b.x0 + b.x1) / 2 between a.x0 and a.x1 and (b.y0 + b.y1) / 2 between a.y0 and a.y1"
_INTER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0.0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0.0)"
_RUNS = "list_filter(list_transform(regexp_extract_all({}, '[0-9][0-9 ]*[0-9]|[0-9]'), lambda r: replace(r, ' ', '')), lambda r: length(r) >= 4)"
_ASSESS = f"select source_sha256, read_no, region_id, concat_ws('; ', case when len({_MISSING}) > 3 then 'words missing' end, case when len(list_filter(wb, lambda w: not list_contains(wa, w) and not contains(sa, w))) > 3 then 'words invented' end, case when len(wb) < 2 then 'hardly read' end) as reason from p"
SQL = {
    "t01_clean_lines": f"select chunk_id, count(line) filter (where rule is null) as kept, count(line) filter (where rule is not null) as dropped, coalesce(length(string_agg(line, chr(10) order by n) filter (where rule is null)), 0)::bigint as n_chars from {_CH} left join {_CLEAN} using (chunk_id) group by 1",
    "s08_audit_split": f"select rule, count(*) as n, count(distinct chunk_id) as n_chunks from {_CLEAN} where rule is not null group by 1",
    "t02_segments": f"with l as (select chunk_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from {_CH}), s as (select *, sum(case when regexp_matches(line, '^[а-яё]\\) ') then 1 else 0 end) over (partition by chunk_id order by n) as segment from l) select chunk_id, segment::bigint as segment, count(*) as n_lines, sum(length(line))::bigint as n_chars from s group by 1, 2",
    "t03_carry_forward": f"select chunk_id, last_value(nullif(regexp_extract(text, '^(\\d+)\\. ', 1), '') ignore nulls) over (w rows between unbounded preceding and current row) as clause, lag(length(text)) over w as n_before from {_CH} window w as (partition by regexp_extract(chunk_id, '^(.*):', 1) order by chunk_id)",
    "t09_structure": "with l as (select chunk_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from (select distinct chunk_id, text from chunks where not is_table)), o as (select regexp_extract(chunk_id, '^(.*):', 1) as document, chunk_id, n, length(line) as n_chars, nullif(regexp_extract(line, '^(\\d+)\\. ', 1), '') as opens, nullif(regexp_extract(line, '^([а-яё])\\) ', 1), '') as opens_entry from l), s as (select *, last_value(opens ignore nulls) over w as clause, nullif(last_value(case when opens is not null then '' else opens_entry end ignore nulls) over w, '') as entry, sum(case when opens is not null or opens_entry is not null then 1 else 0 end) over w as unit from o window w as (partition by document order by chunk_id, n rows between unbounded preceding and current row)) select document, unit::bigint as unit, max(clause) as clause, max(entry) as entry, count(*) as n_lines, sum(n_chars)::bigint as n_chars from s group by 1, 2",
    "a23_parse_counters": f"with k as (select distinct chunk_id, is_table, text from chunks), n as (select chunk_id, count(line) filter (where rule is null) as kept, count(line) filter (where rule is not null) as dropped from {_CLEAN} group by 1) select regexp_extract(chunk_id, '^(.*):', 1) as document, count(*) as n_chunks, count(*) filter (where is_table) as n_tables, coalesce(sum(kept), 0)::bigint as n_lines, coalesce(sum(dropped), 0)::bigint as n_dropped, max(length(text))::bigint as longest, count(*) filter (where length(text) < 120) as small from k left join n using (chunk_id) group by 1",
    "t05_windows": "with k as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null), w as (select doc_id, l, unnest(range(0, len(l), 27)) as i from k) select doc_id, (i // 27)::bigint as window_no, len(case when i = 0 then l[1:30] else l[1:6] || l[i + 1:i + 30] end)::bigint as n_lines, length(array_to_string(case when i = 0 then l[1:30] else l[1:6] || l[i + 1:i + 30] end, chr(10)))::bigint as n_chars from w where i = 0 or i + 3 < len(l)",
    "t06_positional_id": "select region_key, format('{}:{:04d}', substr(source_sha256, 1, 8), row_number() over (partition by substr(source_sha256, 1, 8) order by source_sha256, region_key) - 1) as chunk_id from (select distinct region_key, source_sha256 from regions)",
    "t08_islands": "with k as (select distinct chunk_id, regulation_id, part, section, subsection, clause, appendix from chunks), f as (select *, case when part = lag(part) over w + 1 and section is not distinct from lag(section) over w and subsection is not distinct from lag(subsection) over w and clause is not distinct from lag(clause) over w and appendix is not distinct from lag(appendix) over w then 0 else 1 end as fresh from k window w as (partition by regulation_id order by chunk_id)), i as (select *, sum(fresh) over (partition by regulation_id order by chunk_id) as island from f) select regulation_id, min(chunk_id) as first, max(chunk_id) as last, count(*) as n from i group by regulation_id, island having count(*) > 1",
    "t07_tail_sentence": rf"with k as (select chunk_id, string_split(regexp_replace(trim(regexp_replace(text, '[{_SPACE}]+', ' ', 'g')), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) as s from {_CH}), l as (select chunk_id, list_filter(s, lambda x: length(x) > 0) as s from k) select chunk_id, substr(case when length(s[-1]) < 40 and len(s) > 1 then s[-2] || ' ' || s[-1] else s[-1] end, 1, 220) as tail from l",
    "t08_event_runs": "with f as (select *, case when event_type = lag(event_type) over (partition by user_id order by ts, event_id) then 0 else 1 end as fresh from events), i as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as island from f) select user_id, min(event_id) as first, count(*) as n from i group by user_id, island",
    "j15_word_anti": f"with {_PAIRS} select source_sha256, read_no, region_id, array_to_string({_MISSING}, '|') as missing, round(1 - len({_MISSING}) / nullif(len(wa), 0), 4) as coverage from p",
    "j16_invented": f"with {_PAIRS} select source_sha256, read_no, region_id, array_to_string(list_filter(lb, lambda w: not list_contains(wa, w) and not contains(sa, w)), '|') as invented, round(len(list_filter(lb, lambda w: not list_contains(wa, w) and not contains(sa, w))) / nullif(len(lb), 0), 4) as mismatch from p",
    "j30_diff": f"with {_PAIRS} select source_sha256, read_no, region_id, len(list_filter(wa, lambda w: not list_contains(wb, w)))::bigint as only_first, len(list_filter(wb, lambda w: not list_contains(wa, w)))::bigint as only_second, len(list_filter(wa, lambda w: list_contains(wb, w)))::bigint as common from p",
    "j18_digit_runs": f"with {_PAIRS} select source_sha256, read_no, region_id, array_to_string(list_filter({_RUNS.format('b')}, lambda r: not list_bool_or(list_transform({_RUNS.format('a')}, lambda x: contains(x, r)) || [false])), '|') as unconfirmed from p",
    "j23_markers": f"""with n as (select aspect_id, unnest({_w("lower(aspect_name)", 5)}) as word from aspects), w as (select distinct chunk_id, unnest({_w("lower(text)", 5)}) as word from {_CH}) select aspect_id, word, count(distinct chunk_id) as n_chunks from w join n using (word) group by 1, 2""",
    "j09_token_except": f"with k as (select chunk_id, list_transform(regexp_extract_all(text, '([0-9]+(?:,[0-9]+)?) (?:мг|мм|%|°C)', 1), lambda n: replace(n, ',', '.')) as a, list_transform(regexp_extract_all(string_split(text, chr(10))[1], '([0-9]+(?:,[0-9]+)?) (?:мг|мм|%|°C)', 1), lambda n: replace(n, ',', '.')) as b from {_CH}) select chunk_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(a, lambda n: not list_contains(b, n)))), '|'), '') as numbers from k",
    "j08_verbatim": rf"with k as (select chunk_id, regexp_extract(chunk_id, '^(.*):', 1) as document, regexp_extract(chunk_id, '(\d+)$', 1)::bigint as place, text, string_split(regexp_replace(trim(regexp_replace(text, '[{_SPACE}]+', ' ', 'g')), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) as s0 from {_CH}), t as (select *, list_filter(s0, lambda x: length(x) > 0) as s from k), q as (select chunk_id as from_id, document, place + case when place % 3 = 0 then 0 else 1 end as place, trim(regexp_replace(translate(lower(substr(case when length(s[-1]) < 40 and len(s) > 1 then s[-2] || ' ' || s[-1] else s[-1] end, 1, 220)), 'ё', 'е'), '[{_SPACE}]+', ' ', 'g')) as quote from t), w as (select document, place, chunk_id as cited_id, trim(regexp_replace(translate(lower(text), 'ё', 'е'), '[{_SPACE}]+', ' ', 'g')) as whole from k) select from_id, cited_id, case when cited_id is null then 'absent' when not coalesce(contains(whole, quote), false) then 'not word for word' end as problem from q left join w using (document, place)",
    "f23_bbox": f"select region_key, round(least(greatest(least(x0, x1) * 100 / 100.0, 0.0), 1.0), 6) as x0, round(least(greatest(least(y0, y1) * 100 / 100.0, 0.0), 1.0), 6) as y0, round(least(greatest(greatest(x0, x1) * 100 / 100.0, 0.0), 1.0), 6) as x1, round(least(greatest(greatest(y0, y1) * 100 / 100.0, 0.0), 1.0), 6) as y1 from {_BOX}",
    "j11_box_join": f"select a.source_sha256, a.region_key as outer_id, count(*) as n_inside from {_BOX} a join {_BOX} b on a.source_sha256 = b.source_sha256 and a.region_key <> b.region_key and {_IN} group by 1, 2",
    "j27_smallest_box": f"select b.region_key as inner_id, arg_min(a.region_key, (round((a.x1 - a.x0) * (a.y1 - a.y0), 6), a.region_key)) as outer_id from {_BOX} a join {_BOX} b on a.source_sha256 = b.source_sha256 and a.read_no = b.read_no and {_IN} group by 1",
    "j12_iou_dedup": f"select a.source_sha256, a.kind, a.region_key as id_1, b.region_key as id_2, round({_INTER} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_INTER}), 4) as iou from {_BOX} a join {_BOX} b on a.source_sha256 = b.source_sha256 and a.kind = b.kind and a.region_key < b.region_key where {_INTER} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_INTER}) >= 0.5",
    "c05_assess": f"with {_PAIRS}, s as ({_ASSESS}) select source_sha256, read_no, region_id, case when reason <> '' then 'manual' else 'read' end as status, reason from s",
    "c06_guards": f"with {_PAIRS}, s as ({_ASSESS}) select source_sha256, read_no, count(*) as n, count(*) filter (where reason <> '') as manual, round(count(*) filter (where reason <> '') / count(*), 4) > 0.1 as partial from s group by 1, 2",
    "a24_barcodes": f"with r as (select region_key, unnest(list_distinct({_RUNS.format('text')})) as digits from regions) select digits, case when length(digits) = 13 then 'ean13' when length(digits) in (12, 14) then 'upc or case' when length(digits) = 8 then 'ean8' else 'other' end as kind, count(*) as n, min(region_key) as first from r group by 1, 2",
}
