"""Queries of search, fusion and retrieval metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from ..session import cut
from ..sources.tables import table

c = F.col


def _header_and_text() -> Column:
    head = T.header(c("regulation_name"), c("section"), c("subsection"), F.when(c("appendix").isNotNull(), F.concat(F.lit("Приложение "), c("appendix"))))
    return T.header_and_text(head, c("text"))


def _index(spark: SparkSession, d: str) -> S.Bm25:
    chunks = table(spark, d, "chunks", ["chunk_id", "regulation_name", "section", "subsection", "appendix", "text"])
    return S.Bm25(chunks.select("chunk_id", _header_and_text().alias("text")), "chunk_id", "text")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items", ["item_id", "item_text"]).select(c("item_id").alias("query"), c("item_text").alias("text"))


def _with_rewrites(questions: DataFrame) -> DataFrame:
    """Each question with two shorter texts of it: its first sentence and its words of seven letters or more."""
    long_words = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[а-яёa-z0-9]{7,}"), F.lit(0)), " ")
    texts = F.array(c("text"), F.regexp_extract("text", r"^[^.?!]+", 0), long_words)
    return questions.select("query", F.posexplode(texts).alias("variant", "text"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, d, "embeddings")
    return vectors.where("vec_id % 20 = 0").select(c("vec_id").alias("query"), "embedding"), vectors.select(c("vec_id").alias("doc"), "embedding")


def r01_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", ["doc_id", "text"])
    found = T.tokens(c("text"))
    return docs.select("doc_id", F.size(found).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(found)).cast("bigint").alias("n_distinct")).where("n_tokens >= 0")


def r01_stems(spark: SparkSession, d: str) -> DataFrame:
    """Every token of the chunks with its search form and its count."""
    words = table(spark, d, "chunks", ["chunk_id", "text"]).distinct().select(F.explode(T.raw_tokens(c("text"))).alias("raw"))
    counts = words.groupBy("raw").agg(F.count("*").alias("n"))
    return T.stemmed(counts, "raw", "term").join(counts, "raw")


def r03_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best ten chunks for every question."""
    return _index(spark, d).search(_questions(spark, d))


def r03_bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same among body clauses only, with the statistics of the whole corpus."""
    allowed = table(spark, d, "chunks", ["chunk_id", "is_table", "clause"]).where("not is_table and clause is not null").select(c("chunk_id").alias("doc")).distinct()
    return _index(spark, d).search(_questions(spark, d), allowed=allowed)


def r04_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.cosine_top_k(*_vectors(spark, d))


def r04_cosine_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors among those with an even label only."""
    queries, vectors = _vectors(spark, d)
    even = table(spark, d, "embeddings", ["vec_id", "label"]).where("label % 2 = 0").select(c("vec_id").alias("doc"))
    return S.cosine_top_k(queries, vectors, allowed=even)


def r06_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of the BM25 lists of each question and of its shorter texts, all out of one pass."""
    return S.run_search("bm25", _index(spark, d), _with_rewrites(_questions(spark, d)))


def r07_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of the BM25 list and the vector list of each question over the same chunks."""
    return S.run_search("hybrid", _index(spark, d), _questions(spark, d))


def r08_hybrid_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of the lists of both methods for each question and its shorter texts."""
    return S.run_search("hybrid", _index(spark, d), _with_rewrites(_questions(spark, d)))


def _known_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Last sentences of every twentieth chunk as questions, and the address that each chunk answers for (body clauses only)."""
    chunks = table(spark, d, "chunks", ["chunk_id", "regulation_id", "section", "subsection", "clause", "appendix", "is_table", "text"])
    body = ~c("is_table") & c("clause").isNotNull() & c("appendix").isNull()
    parts = [F.coalesce(c(x), F.lit("<none>")) for x in ("regulation_id", "section", "subsection", "clause")]
    addresses = chunks.select(c("chunk_id").alias("doc"), F.when(body, F.concat_ws("|", *parts)).alias("address")).distinct()
    position = F.regexp_extract("chunk_id", r"(\d+)$", 1).try_cast("bigint")
    known = chunks.where(position % 20 == 0).distinct().select(c("chunk_id").alias("query"), T.tail_sentence(c("text")).alias("text"))
    return cut(known), addresses


def r11_hits(spark: SparkSession, d: str) -> DataFrame:
    """Rank of the first chunk of the right address for each of the questions made of the chunks; unknown ids are an error."""
    queries, addresses = _known_items(spark, d)
    gold = queries.select("query", c("query").alias("doc"))
    ranked = S.hits(_index(spark, d).search(queries), gold, addresses)
    return S.first_hit(ranked, c("is_hit"), queries)


def r13_methods(spark: SparkSession, d: str) -> DataFrame:
    """Rank of the chunk that a question was made of, by each method side by side."""
    queries, _ = _known_items(spark, d)
    index = _index(spark, d)
    # each list is found once, as deep as the fusion needs it; the methods' own lists are its head
    bm25 = cut(index.search(queries, S.CANDIDATES))
    vector = cut(S.cosine_top_k(cut(index.query_vectors(queries)), cut(index.vectors()), S.CANDIDATES))
    found = {"bm25": bm25.where(c("rank") <= S.TOP_K), "vector": vector.where(c("rank") <= S.TOP_K), "hybrid": S.rrf([bm25, vector])}
    lists = [ranking.select("query", "doc", "rank", F.lit(m).alias("method")) for m, ranking in found.items()]
    own = reduce(DataFrame.unionByName, lists).where("query = doc")
    return queries.select("query").distinct().join(own.groupBy("query").pivot("method", ["bm25", "vector", "hybrid"]).agg(F.min("rank")), "query", "left")


def a28_aspect_hits(spark: SparkSession, d: str) -> DataFrame:
    """Whether the best ten chunks for an aspect's name hold one that has a word of the name, and the share of such aspects."""
    names = table(spark, d, "aspects", ["aspect_id", "aspect_name"])
    ranking = _index(spark, d).search(names.select(c("aspect_id").alias("query"), c("aspect_name").alias("text")))
    words = table(spark, d, "chunks", ["chunk_id", "text"]).distinct().select(c("chunk_id").alias("doc"), F.explode(T.words(c("text"), 5)).alias("word"))
    basis = words.join(names.select(c("aspect_id").alias("query"), F.explode(T.words(c("aspect_name"), 5)).alias("word")), "word").select("query", "doc").distinct()
    hit = ranking.join(basis, ["query", "doc"]).select("query").distinct().withColumn("hit", F.lit(1))
    return names.select(c("aspect_id").alias("query")).join(hit, "query", "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("share"))


def _first_hits(spark: SparkSession, d: str) -> DataFrame:
    queries, vectors = _vectors(spark, d)
    labels = table(spark, d, "embeddings", ["vec_id", "label"])
    ranking = S.cosine_top_k(queries, vectors, 11, skip_self=True).where("rank <= 10")
    of_query = labels.select(c("vec_id").alias("query"), c("label").alias("wanted"))
    ranked = ranking.join(of_query, "query").join(labels.select(c("vec_id").alias("doc"), "label"), "doc")
    return S.first_hit(ranked, c("label").eqNullSafe(c("wanted")), queries)


def r10_first_hit(spark: SparkSession, d: str) -> DataFrame:
    return _first_hits(spark, d)


def a01_hit_mrr(spark: SparkSession, d: str) -> DataFrame:
    return S.hit_metrics(_first_hits(spark, d))


def a02_by_dim(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings", ["vec_id", "label"]).select(c("vec_id").alias("query"), "label", (c("vec_id") % 3).alias("part"))
    return S.hit_metrics(_first_hits(spark, d).join(labels, "query"), by=[[], ["label"], ["part"]])


def a03_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Mean, median and tenth percentile of the best cosine, on hits and on misses."""
    queries, vectors = _vectors(spark, d)
    best = S.cosine_top_k(queries, vectors, 2, skip_self=True).where("rank = 1").select("query", "score")
    first = _first_hits(spark, d).select("query", F.when(c("rank").isNull(), "miss").otherwise("hit").alias("part"))
    both = best.join(first, "query").withColumn("part", F.explode(F.array("part", F.lit("all"))))
    return both.groupBy("part").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.round(F.median("score"), 4).alias("median"), F.round(F.percentile("score", 0.1), 4).alias("p10")
    )


def j01_hits_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of the ranked ids."""
    hits = _index(spark, d).search(_questions(spark, d), 3)
    chunks = table(spark, d, "chunks", ["chunk_id", "regulation_id", "clause"]).distinct()
    return hits.join(chunks, hits["doc"] == chunks["chunk_id"]).select("query", "rank", "chunk_id", "regulation_id", "clause")


QUERIES = {
    f.__name__: f
    for f in (r01_tokens, r01_stems, r03_bm25_topk, r03_bm25_filtered, r04_cosine_topk, r04_cosine_filtered, r06_rrf, r07_hybrid, r08_hybrid_rewritten, r10_first_hit, r11_hits, r13_methods)
    + (a01_hit_mrr, a02_by_dim, a03_percentiles, a28_aspect_hits, j01_hits_lookup)
}
_RAW = "regexp_extract_all(lower({}), '[а-яёa-z0-9]+')"
_ONE = "translate(regexp_replace({}, '^e([0-9]+)$', 'е\\1'), 'ё', 'е')"
_TOKENS = f"list_transform({_RAW}, lambda t: {_ONE.format('t')})"
_HEAD = "concat_ws('. ', nullif(regulation_name,''), nullif(section,''), nullif(subsection,''), case when appendix is not null then 'Приложение ' || appendix end)"
#: The rules of the stemmer as SQL: (column, expression); ``{0}`` is the token, others are columns before.
_STEM_STEPS = [
    ("head", f"regexp_extract({{0}}, '^[^{T.VOWELS}]*[{T.VOWELS}]', 0)"),
    ("rv", "case when head = '' then '' else substr({0}, length(head) + 1) end"),
    ("start", "case when head = '' then {0} else head end"),
    ("far", f"length(regexp_extract({{0}}, '^.*?[{T.VOWELS}][^{T.VOWELS}].*?[{T.VOWELS}][^{T.VOWELS}]', 0))"),
    ("gerund", f"regexp_replace(rv, '{T._ending(*T.GERUND)}', '@1')"),
    ("plain", f"regexp_replace(rv, '{T._ending(T.REFLEXIVE)}', '')"),
    ("adjective", f"regexp_replace(plain, '{T._ending(T.ADJECTIVE)}', '')"),
    ("participle", f"regexp_replace(adjective, '{T._ending(*T.PARTICIPLE)}', '@1')"),
    ("verb", f"regexp_replace(plain, '{T._ending(*T.VERB)}', '@1')"),
    ("noun", f"regexp_replace(plain, '{T._ending(T.NOUN)}', '')"),
    ("first", "case when gerund <> rv then gerund when adjective <> plain then participle when verb <> plain then verb else noun end"),
    ("second", "regexp_replace(first, 'и$', '')"),
    ("third", "case when far > 0 and length(start) + length(second) - far >= length(regexp_extract(second, 'ость?$', 0)) then regexp_replace(second, 'ость?$', '') else second end"),
    ("best", "regexp_replace(third, 'ейше?$', '')"),
    ("stem", "concat(start, case when best <> third or third like '%нн' then regexp_replace(best, 'нн$', 'н') else regexp_replace(third, 'ь$', '') end)"),
]
_STEPS = ", ".join(f"{step.format('tok').replace('@', chr(92))} as {name}" for name, step in _STEM_STEPS)
_STEM = f"select raw, case when regexp_matches(tok, '[0-9a-z]') then tok else stem end as term from (select *, {_STEPS} from (select raw, {_ONE.format('raw')} as tok from ({{}})))"
_LISTS = f"""
corpus as (select distinct chunk_id as doc, case when {_HEAD} <> '' then {_HEAD} || chr(10) || text else text end as text from chunks),
words as (select doc, {_RAW.format('text')} as words from corpus),
stats as (select count(*)::double as n, avg(coalesce(len(words), 0)) as mean_length from words),
raws as (select doc, len(words) as length, unnest(words) as raw from words),
forms as ({_STEM.format('select distinct raw from raws')}),
postings as (select doc, length, term, count(*) as tf from raws join forms using (raw) group by all),
raw_idf as (select term, ln(n - df + 0.5) - ln(df + 0.5) as raw from (select term, count(*) as df from postings group by term), stats),
idf as (select term, case when raw < 0 then {S.EPSILON} * (select avg(raw) from raw_idf) else raw end as idf from raw_idf),
weights as (select doc, ('0x' || substr(md5(term), 1, 2))::int % 64 as bucket, sum(case when ('0x' || substr(md5(term), 3, 2))::int % 2 = 0 then 1 else -1 end * tf * idf) as v from postings join idf using (term) group by 1, 2),
norms as (select doc, sqrt(sum(v * v)) as norm from weights group by 1)"""


def _asked(queries: str, name: str) -> str:
    return f"""q_{name} as (select query, variant, unnest({_RAW.format('text')}) as raw from ({queries})), s_{name} as ({_STEM.format(f'select distinct raw from q_{name}')}),
asked_{name} as (select query, variant, term, count(*) as times from q_{name} join s_{name} using (raw) group by all)"""


def _bm25(name: str, k: int, extra: str = "") -> str:
    return f"""scored_{name} as (select query, variant, doc, round(sum(times * idf * tf * {S.K1 + 1} / (tf + {S.K1} * (1 - {S.B} + {S.B} * length / mean_length))), 6) as score
  from postings join idf using (term) join asked_{name} using (term), stats {extra} group by query, variant, doc),
bm25_{name} as (select * from (select *, row_number() over (partition by query, variant order by score desc, doc) as rank from scored_{name} where score > 0) where rank <= {k})"""


def _vector(name: str, k: int) -> str:
    return f"""w_{name} as (select query, variant, ('0x' || substr(md5(term), 1, 2))::int % 64 as bucket, sum(case when ('0x' || substr(md5(term), 3, 2))::int % 2 = 0 then 1 else -1 end * times * idf) as v from asked_{name} join idf using (term) group by 1, 2, 3),
n_{name} as (select query, variant, sqrt(sum(v * v)) as norm from w_{name} group by 1, 2),
c_{name} as (select query, variant, doc, round(sum(coalesce(w.v, 0) * d.v) / any_value(q.norm) / any_value(norms.norm), 6) as score from n_{name} q cross join weights d join norms using (doc) left join w_{name} w using (query, variant, bucket) where q.norm > 0 and norms.norm > 0 group by 1, 2, 3),
vector_{name} as (select * from (select *, row_number() over (partition by query, variant order by score desc, doc) as rank from c_{name}) where rank <= {k})"""


_ALL = "select item_id as query, 0 as variant, item_text as text from eval_items"
_REWRITES = "select query, unnest([0, 1, 2]) as variant, unnest([text, regexp_extract(text, '^[^.?!]+', 0), array_to_string(regexp_extract_all(lower(text), '[а-яёa-z0-9]{7,}'), ' ')]) as text from (select item_id as query, item_text as text from eval_items)"
_RRF = "select * from (select query, doc, score, row_number() over (partition by query order by score desc, doc) as rank from (select query, doc, round(sum(1.0 / (60 + rank)), 8)::double as score from ({}) group by query, doc)) where rank <= 10"
_BOTH = "select query, doc, rank from bm25_a union all select query, doc, rank from vector_a"
_BLANK = r"\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{1680}\x{85}\x{2028}\x{2029}\x0b"
_TAIL = rf"(select chunk_id, substr(case when length(s[-1]) < 40 and len(s) > 1 then s[-2] || ' ' || s[-1] else s[-1] end, 1, 220) as tail from (select chunk_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '[{_BLANK}]+', ' ', 'g')), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda x: length(x) > 0) as s from (select distinct chunk_id, text from chunks where try_cast(regexp_extract(chunk_id, '(\d+)$', 1) as bigint) % 20 = 0)))"
_KNOWN = f"select chunk_id as query, 0 as variant, tail as text from {_TAIL}"
_ADDRESS = "select distinct chunk_id as doc, case when not is_table and clause is not null and appendix is null then concat_ws('|', coalesce(regulation_id, '<none>'), coalesce(section, '<none>'), coalesce(subsection, '<none>'), coalesce(clause, '<none>')) end as address from chunks"
_ONLY = "where doc in (select chunk_id from chunks where not is_table and clause is not null)"
_COSINE = "cosine as (select q.vec_id as query, v.vec_id as doc, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score, v.label as label, q.label as wanted from embeddings q, embeddings v where q.vec_id % 20 = 0)"
_FIRST = f"{_COSINE}, ranked as (select *, row_number() over (partition by query order by score desc, doc) as rank from cosine where query <> doc), first_hits as (select query, min(rank) filter (where label is not distinct from wanted and rank <= 10) as rank from ranked group by query)"
_METRICS = "count(*) as n, " + ", ".join(f"round(avg(case when rank <= {k} then 1.0 else 0.0 end), 4)::double as hit_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1.0 / rank, 0.0)), 4)::double as mrr"
SQL = {
    "r01_tokens": f"select doc_id, len({_TOKENS.format('text')})::bigint as n_tokens, len(list_distinct({_TOKENS.format('text')}))::bigint as n_distinct from documents where text is not null",
    "r01_stems": f"with raws as (select unnest({_RAW.format('text')}) as raw from (select distinct chunk_id, text from chunks)), forms as ({_STEM.format('select distinct raw from raws')}) select raw, term, n from (select raw, count(*) as n from raws group by 1) join forms using (raw)",
    "r03_bm25_topk": f"with {_LISTS}, {_asked(_ALL, 'a')}, {_bm25('a', 10)} select query, doc, score, rank from bm25_a",
    "r03_bm25_filtered": f"with {_LISTS}, {_asked(_ALL, 'a')}, {_bm25('a', 10, _ONLY)} select query, doc, score, rank from bm25_a",
    "r04_cosine_filtered": f"with {_COSINE} select query, doc, score, rank from (select *, row_number() over (partition by query order by score desc, doc) as rank from cosine where label % 2 = 0) where rank <= 10",
    "r04_cosine_topk": f"with {_COSINE} select query, doc, score, rank from (select *, row_number() over (partition by query order by score desc, doc) as rank from cosine) where rank <= 10",
    "r06_rrf": f"with {_LISTS}, {_asked(_REWRITES, 'a')}, {_bm25('a', 20)} " + _RRF.format("select query, doc, rank from bm25_a"),
    "r07_hybrid": f"with {_LISTS}, {_asked(_ALL, 'a')}, {_bm25('a', 20)}, {_vector('a', 20)} " + _RRF.format(_BOTH),
    "r08_hybrid_rewritten": f"with {_LISTS}, {_asked(_REWRITES, 'a')}, {_bm25('a', 20)}, {_vector('a', 20)} " + _RRF.format(_BOTH),
    "r11_hits": f"with {_LISTS}, {_asked(_KNOWN, 'a')}, {_bm25('a', 10)}, adr as ({_ADDRESS}), h as (select query, min(rank) as rank from bm25_a join adr x using (doc) join adr y on y.doc = query where bm25_a.doc = query or x.address = y.address group by 1) select distinct query, rank from (select chunk_id as query from {_TAIL}) left join h using (query)",
    "r13_methods": f"with {_LISTS}, {_asked(_KNOWN, 'a')}, {_bm25('a', 20)}, {_vector('a', 20)}, f as ({_RRF.format(_BOTH)}), k as (select distinct chunk_id as query from {_TAIL}) select query, b.rank as bm25, v.rank as vector, f.rank as hybrid from k left join (from bm25_a where query = doc and rank <= 10) b using (query) left join (from vector_a where query = doc and rank <= 10) v using (query) left join (from f where query = doc) f using (query)",
    "a28_aspect_hits": f"with {_LISTS}, {_asked('select aspect_id as query, 0 as variant, aspect_name as text from aspects', 'a')}, {_bm25('a', 10)}, w as (select distinct chunk_id as doc, unnest(regexp_extract_all(translate(lower(text), 'ё', 'е'), '[\\p{{L}}\\p{{N}}]+')) as word from chunks), n as (select aspect_id as query, unnest(regexp_extract_all(translate(lower(aspect_name), 'ё', 'е'), '[\\p{{L}}\\p{{N}}]+')) as word from aspects), h as (select distinct query from bm25_a join n using (query) join w using (doc, word) where length(word) >= 5) select count(*) as n, count(h.query) as hits, round(avg(case when h.query is null then 0 else 1 end), 4) as share from aspects left join h on h.query = aspect_id",
    "r10_first_hit": f"with {_FIRST} select query, rank from first_hits",
    "a01_hit_mrr": f"with {_FIRST} select {_METRICS} from first_hits",
    "a02_by_dim": f"with {_FIRST} select label, part, {_METRICS} from (select f.*, e.label, vec_id % 3 as part from first_hits f join embeddings e on e.vec_id = f.query) group by grouping sets ((), (label), (part))",
    "a03_percentiles": f"with {_FIRST}, best as (select query, score from ranked where rank = 1), b as (select score, unnest([case when rank is null then 'miss' else 'hit' end, 'all']) as part from best join first_hits using (query)) select part, count(*) as n, round(avg(score), 4) as mean, round(quantile_cont(score, 0.5), 4) as median, round(quantile_cont(score, 0.1), 4) as p10 from b group by part",
    "j01_hits_lookup": f"with {_LISTS}, {_asked(_ALL, 'a')}, {_bm25('a', 3)} select query, rank, chunk_id, regulation_id, clause from bm25_a join (select distinct chunk_id, regulation_id, clause from chunks) on chunk_id = doc",
}
