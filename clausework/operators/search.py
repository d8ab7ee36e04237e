"""Ranking: BM25 over token postings, cosine over dense vectors, reciprocal-rank fusion."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, raw_tokens, search_form, stemmed
from ..session import cut

K1, B, EPSILON = 1.5, 0.75, 0.25
CANDIDATES, TOP_K, RRF_K = 20, 10, 60
#: Queries and vectors of one matrix product.
QUERY_BLOCK, VECTOR_BLOCK = 32768, 65536
#: Postings of the queries' terms beyond which queries and documents meet in blocks; queries and documents of such a block.
MANY, ASKED_BLOCK, DOC_BLOCK = 20_000_000, 32768, 32768
_TOKEN = re.compile(TOKEN)
#: Rows and columns of one matrix of scores, and the share of its pairs from which on a term is a column of the product.
SCORE_ROWS, SCORE_COLUMNS, DENSE = 512, 4096, 1 / 300


def vocabulary(terms: DataFrame) -> DataFrame:
    """(raw, term): each distinct raw token in its form for search (codes in one alphabet, Russian words by their stem)."""
    return stemmed(terms.select("raw").distinct(), "raw", "term")


def counted_terms(texts: DataFrame, kind: str) -> DataFrame:
    """(doc, length, terms, tfs) of rows (doc, text): number of tokens, distinct search forms and their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(map(search_form, _TOKEN.findall(text or ""))) for text in batch["text"].to_pylist()]
            columns = [pa.array([x.total() for x in found], pa.int32()), pa.array([[*x] for x in found], pa.list_(pa.string())), pa.array([[*x.values()] for x in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch["doc"], *columns], ["doc", "length", "terms", "tfs"])

    return texts.select("doc", F.lower("text").alias("text")).mapInArrow(run, f"doc {kind}, length int, terms array<string>, tfs array<int>")


class Bm25:
    """Postings and statistics of a corpus. Statistics always cover the whole corpus, whatever a search filters.

    Repeated rows of one key and text count once. The index has one row a document, with its distinct terms and their
    counts; a worker brings each token to its search form once. One aggregate by term gives the documents of each term
    and, at no term, their number and length.
    """

    def __init__(self, corpus: DataFrame, key: str, text: str):
        texts = corpus.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull())
        # the index is written once: every statistic and every search reads it and none tokenizes the corpus again
        self.index = cut(counted_terms(texts.repartition("doc").distinct(), dict(texts.dtypes)["doc"]))
        self.postings = self.index.select("doc", "length", F.explode(F.arrays_zip("terms", "tfs")).alias("one")).select("doc", "length", F.col("one.terms").alias("term"), F.col("one.tfs").cast("bigint").alias("tf"))
        every = self.index.select("length", F.explode(F.concat(F.array(F.lit(None).cast("string")), "terms")).alias("term"))
        self.terms = cut(every.groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("lengths")))
        self._numbers: tuple[float, float, float] | None = None

    def numbers(self) -> tuple[float, float, float]:
        """Number of documents, their mean length, and the mean idf over all terms."""
        if self._numbers is None:
            none = self.terms.where("term is null").select("df", "lengths")
            n, total = none.first() or (0, 0)
            mean_idf = self.terms.where("term is not null").agg(F.avg(_raw_idf(n))).first()[0]
            self._numbers = float(n), float(total / n) if n else 0.0, float(mean_idf or 0.0)
        return self._numbers

    def idf(self) -> DataFrame:
        """(term, idf); a negative idf is replaced by ``EPSILON`` times the mean over all terms."""
        n, _, mean_idf = self.numbers()
        raw = _raw_idf(n)
        return self.terms.where("term is not null").select("term", F.when(raw < 0, EPSILON * mean_idf).otherwise(raw).alias("idf"))

    def search(self, queries: DataFrame, k: int | None = TOP_K, allowed: DataFrame | None = None) -> DataFrame:
        """(query, doc, score, rank) of the best ``k`` documents of each query (``None`` or 0: ``CANDIDATES``).

        ``queries``: ``query``, ``text``, and ``variant`` where a query has several texts, each with a list of its own
        out of the same pass; repeated tokens of a query count each time. ``allowed``: ``query``, ``doc`` pairs or
        only ``doc``; None allows all, an empty frame none. Scores that are not above 0 do not come out; ties go to
        the smaller document key. The postings are cut to the queries' terms before they are joined, and the scores
        are summed map-side; where the terms have more than ``MANY`` postings in all, see :meth:`_in_blocks`.
        """
        _, mean_length, _ = self.numbers()
        keys = [c for c in ("query", "variant") if c in queries.columns]
        raw = queries.select(*keys, F.explode(raw_tokens(F.col("text"))).alias("raw"))
        asked = cut(raw.join(vocabulary(raw), "raw").groupBy(*keys, "term").agg(F.count("*").alias("times")))
        if allowed is None or "query" not in allowed.columns:
            if (asked.join(self.terms, "term").agg(F.sum("df")).first()[0] or 0) > MANY:
                return top_k(self._in_blocks(asked, keys, k or CANDIDATES, allowed), k or CANDIDATES, keys)
        hits = self.postings.join(asked.join(self.idf(), "term"), "term")
        if allowed is not None:
            hits = hits.join(allowed, [c for c in ("query", "doc") if c in allowed.columns], "left_semi")
        tf, length = F.col("tf"), F.col("length")
        part = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean_length)))
        scores = hits.groupBy(*keys, "doc").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
        return top_k(scores, k or CANDIDATES, keys)

    def _in_blocks(self, asked: DataFrame, keys: list[str], k: int, allowed: DataFrame | None) -> DataFrame:
        """(keys, doc, score) of the best ``k`` documents of each block of documents, for many queries.

        No row for each query, term and document: blocks of queries meet blocks of documents, each pair in a task of
        its own that adds up a matrix of scores and keeps the best. All documents are scored.
        """
        n, mean_length, _ = self.numbers()
        name = F.struct(*keys).alias("query") if len(keys) > 1 else F.col("query")
        weights = asked.join(self.idf(), "term").select(name, F.struct("term", (F.col("times") * F.col("idf")).alias("weight")).alias("one"))
        queries = cut(weights.groupBy("query").agg(F.collect_list("one").alias("all")).select("query", F.col("all.term").alias("terms"), F.col("all.weight").alias("weights")))
        docs = self.index if allowed is None else self.index.join(allowed, "doc", "left_semi")
        across = max(1, -(-queries.count() // ASKED_BLOCK))
        down = max(1, -(-int(n) // DOC_BLOCK), min(4 * asked.sparkSession.sparkContext.defaultParallelism, int(n) // 1024))
        left = docs.withColumn("down", F.pmod(F.xxhash64("doc"), F.lit(down)).cast("int")).withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
        right = queries.withColumn("across", F.pmod(F.xxhash64("query"), F.lit(across)).cast("int")).withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))

        def best(docs: pa.Table, asked: pa.Table) -> pa.Table:
            docs = docs.sort_by("doc")  # ties go to the smaller key
            at_query, at_doc, scores = _bm25_of_blocks(docs, asked, k, mean_length)
            return _named(asked["query"], docs["doc"], at_query, at_doc, scores)

        kinds = dict(queries.dtypes)["query"], dict(self.index.dtypes)["doc"]
        found = left.groupBy("down", "across").cogroup(right.groupBy("down", "across")).applyInArrow(best, f"query {kinds[0]}, doc {kinds[1]}, score double").where("score > 0")
        return found.select(*(F.col(f"query.{c}").alias(c) if len(keys) > 1 else F.col(c) for c in keys), "doc", "score")

    def vectors(self, dims: int = 64) -> DataFrame:
        """(doc, embedding): the tf-idf weights of each document's terms hashed into ``dims`` signed buckets.

        A vector for documents where no model is at hand; any frame of ``doc`` and ``embedding`` can stand for it.
        """
        return hashed_vectors(self.postings, self.idf(), "doc", dims)

    def query_vectors(self, queries: DataFrame, dims: int = 64) -> DataFrame:
        """(query, embedding), with ``variant`` where there is one, by the same weights."""
        keys = [c for c in ("query", "variant") if c in queries.columns]
        raw = queries.select(*keys, F.explode(raw_tokens(F.col("text"))).alias("raw"))
        asked = raw.join(vocabulary(raw), "raw").groupBy(*keys, "term").agg(F.count("*").alias("tf"))
        named = asked.select(F.struct(*keys).alias("query") if len(keys) > 1 else F.col("query"), "term", "tf")
        return hashed_vectors(named, self.idf(), "query", dims)


def _raw_idf(n: float) -> Column:
    return F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def hashed_vectors(counts: DataFrame, idf: DataFrame, key: str, dims: int) -> DataFrame:
    """(key, embedding) of rows (key, term, tf) and (term, idf): bucket and sign of a term by its MD5, once a term; summed map-side."""
    digest = F.md5(F.col("term").cast("binary"))
    byte = lambda at: F.conv(F.substring(digest, at, 2), 16, 10).cast("int")
    hashed = idf.select("term", (byte(1) % dims).alias("bucket"), (F.when(byte(3) % 2 == 0, 1.0).otherwise(-1.0) * F.col("idf")).alias("weight"))
    parts = counts.join(hashed, "term").select(key, "bucket", (F.col("tf") * F.col("weight")).alias("part"))
    buckets = parts.groupBy(key, "bucket").agg(F.sum("part").alias("value"))
    found = buckets.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("values"))  # dims entries at most
    return found.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("values", i), F.lit(0.0))).alias("embedding"))


def _named(names: pa.ChunkedArray, docs: pa.ChunkedArray, at_query: np.ndarray, at_doc: np.ndarray, scores: np.ndarray) -> pa.Table:
    """(query, doc, score) of scores by the places of their query and document."""
    if pa.types.is_struct(names.type):
        names = names.cast(pa.struct([f.with_nullable(True) for f in names.type]))
    return pa.table([names.take(pa.array(at_query)), docs.take(pa.array(at_doc)), pa.array(scores, pa.float64())], names=["query", "doc", "score"])


class _Best:
    """The best ``k`` of each row of matrices of scores that come one after the other, rounded.

    Ties go to the earlier column; with ``ties`` all that reach the k-th best are kept.
    """

    def __init__(self, rows: int, k: int, least: float, ties: bool = False):
        self.k, self.bar, self.some, self.ties = k, np.full(rows, least), False, ties
        self.row, self.column, self.score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)

    def add(self, scores: np.ndarray, first: int) -> None:
        n, slack = scores.shape[1], 1.1e-6  # two scores that differ by more stay apart when rounded
        if not self.some and n >= self.k:
            self.bar, self.some = np.maximum(self.bar, np.partition(scores, n - self.k, axis=1)[:, n - self.k] - slack), True
        at = np.flatnonzero(scores >= self.bar[:, None])
        if not len(at):
            return
        row, column, score = np.append(self.row, at // n), np.append(self.column, first + at % n), np.append(self.score, np.round(scores.ravel()[at], 6))
        order = np.lexsort((column, -score, row))
        row, column, score = row[order], column[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        last = rank == self.k - 1
        self.bar[row[last]] = np.maximum(self.bar[row[last]], score[last] - slack)
        reached = np.full(len(self.bar), -np.inf)
        reached[row[last]] = score[last]
        kept = score >= reached[row] if self.ties else rank < self.k
        self.row, self.column, self.score = row[kept], column[kept], score[kept]


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each value, and the values."""
    one = lists.combine_chunks() if lists.num_chunks != 1 else lists.chunk(0)
    return np.repeat(np.arange(len(one)), pc.list_value_length(one).to_numpy(zero_copy_only=False)), one.flatten()


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (``count`` of them), one range after the other."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


def _bm25_of_blocks(docs: pa.Table, asked: pa.Table, k: int, mean_length: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the document, score) of the best ``k`` for each query.

    Terms that many queries of a matrix share with many documents are a matrix product, all others are added posting
    by posting; queries with like terms lie together, so that few terms are columns of one product.
    """
    d_row, d_name = _flat(docs["terms"])
    q_row, q_name = _flat(asked["terms"])
    weight, tf = _flat(asked["weights"])[1].to_numpy(), _flat(docs["tfs"])[1].to_numpy().astype(np.float64)
    terms = pc.unique(q_name)
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    if not len(terms) or not len(d_name):
        return out[0]
    q_term = pc.index_in(q_name, value_set=terms).to_numpy()
    d_term = pc.index_in(d_name, value_set=terms).fill_null(-1).to_numpy()
    value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * docs["length"].to_numpy()[d_row] / mean_length))
    known = d_term >= 0
    d_row, d_term, value = d_row[known], d_term[known], value[known]

    met = np.bincount(q_term, minlength=len(terms)) * np.bincount(d_term, minlength=len(terms))
    bit = np.full(len(terms), 64)
    bit[np.argsort(-met, kind="stable")[:64]] = np.arange(min(64, len(terms)))
    look = np.zeros((asked.num_rows, 65), bool)
    look[q_row, bit[q_term]] = True
    order = np.argsort(np.packbits(look[:, :64], axis=1).view(">u8").ravel(), kind="stable")
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    by_place = np.argsort(place[q_row], kind="stable")
    q_row, q_term, weight = place[q_row][by_place], q_term[by_place], weight[by_place]

    slices = []
    for first in range(0, docs.num_rows, SCORE_COLUMNS):
        lo, hi = np.searchsorted(d_row, (first, first + SCORE_COLUMNS))
        by_term = lo + np.argsort(d_term[lo:hi], kind="stable")
        slices.append((first, min(SCORE_COLUMNS, docs.num_rows - first), np.searchsorted(d_term[by_term], np.arange(len(terms) + 1)), d_row[by_term] - first, value[by_term]))
    for a in range(0, len(order), SCORE_ROWS):
        rows = min(SCORE_ROWS, len(order) - a)
        lo, hi = np.searchsorted(q_row, (a, a + rows))
        row, by = q_row[lo:hi] - a, weight[lo:hi]
        used, at, times = np.unique(q_term[lo:hi], return_inverse=True, return_counts=True)
        best = _Best(rows, k, 4e-7)  # less is 0 when rounded
        for first, columns, start, column, worth in slices:
            held = start[used + 1] - start[used]
            dense = held * times > rows * columns * DENSE
            number = np.cumsum(dense) - 1
            product = np.zeros((rows, dense.sum()))
            many = dense[at]
            product[row[many], number[at[many]]] = by[many]
            matrix = np.zeros((dense.sum(), columns))
            found = _ranges(start[used[dense]], held[dense])
            matrix[np.repeat(np.arange(len(matrix)), held[dense]), column[found]] = worth[found]
            scores = product @ matrix
            few = ~many
            found, count = _ranges(start[used[at[few]]], held[at[few]]), held[at[few]]
            np.add.at(scores.ravel(), np.repeat(row[few] * columns, count) + column[found], np.repeat(by[few], count) * worth[found])
            best.add(scores, first)
        out.append((order[a + best.row], best.column, best.score))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_k(scores: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """The best ``k`` of each query with their rank from 1; Spark cuts each partition to k before the shuffle."""
    order = Window.partitionBy(*(keys or ["query"])).orderBy(F.desc("score"), "doc")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, skip_self: bool = False, allowed: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, rank) by cosine. ``queries``: ``query``, ``embedding``; ``vectors``: ``doc``, ``embedding``.

    The stated set of queries against all rows, in blocks: blocks of about ``QUERY_BLOCK`` queries meet blocks of
    about ``VECTOR_BLOCK`` vectors, each pair in a task of its own as matrix products; a task keeps its own best ``k``
    of each query. Nothing passes through the driver but the numbers of rows. ``allowed``: ``doc``. Null vectors and
    vectors of length 0 match nothing.
    """
    asked = queries.where("embedding is not null").select("query", "embedding")
    found = vectors.where("embedding is not null").select("doc", "embedding")
    if allowed is not None:
        found = found.join(allowed, "doc", "left_semi")
    n_asked, n_found = asked.count(), found.count()
    across, down = max(1, -(-n_asked // QUERY_BLOCK)), max(1, -(-n_found // VECTOR_BLOCK), min(n_found, vectors.sparkSession.sparkContext.defaultParallelism))
    left = found.withColumn("down", F.pmod(F.xxhash64("doc", "embedding"), F.lit(down))).withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = asked.withColumn("across", F.pmod(F.xxhash64("query"), F.lit(across)).cast("int")).withColumn("down", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(down - 1).cast("bigint"))))

    def best(docs: pa.Table, asked: pa.Table) -> pa.Table:
        at_query, at_doc, scores = _cosine_of_blocks(docs, asked, k + skip_self)
        return _named(asked["query"], docs["doc"], at_query, at_doc, scores)

    kinds = dict(asked.dtypes)["query"], dict(found.dtypes)["doc"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # sides of one table are told apart
    scores = left.groupBy("down", "across").cogroup(right.groupBy("down", "across")).applyInArrow(best, f"query {kinds[0]}, doc {kinds[1]}, score double")
    if skip_self:
        scores = scores.where(~F.col("query").eqNullSafe(F.col("doc")))
    return top_k(scores, k)


def _cosine_of_blocks(docs: pa.Table, asked: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the document, score) of the best ``k`` for each query, and of all with the score of the last."""
    matrix, seen = _units(_rows_of(asked["embedding"]))
    slices = []
    for first in range(0, docs.num_rows if len(seen) else 0, SCORE_COLUMNS):
        part, full = _units(_rows_of(docs["embedding"].slice(first, SCORE_COLUMNS)))
        if len(full):
            slices.append((part.T, first + full))
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    places = np.concatenate([at for _, at in slices]) if slices else None
    for a in range(0, len(seen) if slices else 0, SCORE_ROWS):
        best, first = _Best(len(matrix[a : a + SCORE_ROWS]), k, -np.inf, ties=True), 0
        for part, at in slices:
            best.add(matrix[a : a + SCORE_ROWS] @ part, first)
            first += len(at)
        out.append((seen[a + best.row], places[best.column], best.score))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a length above 0, at length 1, and their places."""
    length = np.linalg.norm(rows, axis=1) if len(rows) else np.zeros(0)
    full = np.flatnonzero(length > 0)
    return rows[full] / length[full, None], full


def _rows_of(vectors: pa.ChunkedArray) -> np.ndarray:
    """The vectors as the rows of a matrix."""
    flat = vectors.combine_chunks() if vectors.num_chunks != 1 else vectors.chunk(0)
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def rrf(rankings: list[DataFrame], rrf_k: int = RRF_K, k: int = TOP_K) -> DataFrame:
    """Reciprocal-rank fusion of rankings (``query``, ``doc``, ``rank``): score = sum of 1 / (rrf_k + rank); ties to the smaller key."""
    every = reduce(DataFrame.unionByName, [r.select("query", "doc", "rank") for r in rankings])
    fused = every.groupBy("query", "doc").agg(F.round(F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))), 8).alias("score"))
    return top_k(fused, k)


def run_search(method: str, index: Bm25, queries: DataFrame, vectors: DataFrame | None = None, k: int = TOP_K, rrf_k: int = RRF_K) -> DataFrame:
    """(query, doc, score, rank) by ``method``: ``bm25``, ``vector`` or ``hybrid``.

    ``queries`` with one text each give the method's own list; with ``variant`` (a query and its rewrites) the lists
    of all variants are fused, for ``hybrid`` those of both methods. ``vectors``: ``doc``, ``embedding``; by default
    the hashed ones of the index.
    """
    several = "variant" in queries.columns
    fused = several or method == "hybrid"
    depth = CANDIDATES if fused else k
    lists = []
    if method in ("bm25", "hybrid"):
        lists.append(index.search(queries, depth).withColumn("list", F.concat(F.lit("bm25-"), F.col("variant").cast("string") if several else F.lit(""))))
    if method in ("vector", "hybrid"):
        found = cosine_top_k(index.query_vectors(queries), index.vectors() if vectors is None else vectors, depth)
        if several:
            found = found.select(F.col("query.variant").alias("variant"), F.col("query.query").alias("query"), "doc", "score", "rank")
        lists.append(found.withColumn("list", F.concat(F.lit("vector-"), F.col("variant").cast("string") if several else F.lit(""))))
    if not lists:
        raise ValueError(f"unknown method {method}")
    return rrf(lists, rrf_k, k) if fused else lists[0].select("query", "doc", "score", "rank")


def known_only(rows: DataFrame, id_column: str, corpus: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """``rows`` with the columns ``keep`` of their corpus row; an id that the corpus does not have is an error when it is met."""
    right = corpus.select(F.col(key).alias("_known"), *(F.col(c).alias(f"_{c}") for c in keep)).dropDuplicates(["_known"])
    joined = rows.join(right, rows[id_column] == right["_known"], "left")
    there = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown id: "), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))))).otherwise(F.col("_known"))
    return joined.withColumn(id_column, there.cast(dict(rows.dtypes)[id_column])).select(*rows.columns, *(F.col(f"_{c}").alias(c) for c in keep))


def hits(ranking: DataFrame, gold: DataFrame, addresses: DataFrame) -> DataFrame:
    """``ranking`` (``query``, ``doc``, ``rank``) with ``is_hit``: the address of the document is that of a gold one, or it is one.

    ``gold``: ``query``, ``doc``, each accepted document a row; ``addresses``: ``doc``, ``address``. Unknown documents on
    either side are an error. Documents without an address are hit by their id only.
    """
    accepted = known_only(gold, "doc", addresses, "doc", ["address"]).select("query", F.col("doc").alias("gold_doc"), F.col("address").alias("gold_address"))
    ranked = known_only(ranking, "doc", addresses, "doc", ["address"])
    by_id = accepted.select("query", F.col("gold_doc").alias("doc"), F.lit(True).alias("by_id")).distinct()
    by_address = accepted.where("gold_address is not null").select("query", F.col("gold_address").alias("address"), F.lit(True).alias("by_address")).distinct()
    # two joins by equality in place of one by either
    return ranked.join(by_id, ["query", "doc"], "left").join(by_address, ["query", "address"], "left").select(*ranking.columns, F.coalesce("by_id", "by_address", F.lit(False)).alias("is_hit"))


def first_hit(ranking: DataFrame, is_hit: Column, queries: DataFrame) -> DataFrame:
    """(query, rank): the rank of the first hit of each query, null where there is none."""
    best = ranking.groupBy("query").agg(F.min(F.when(is_hit, F.col("rank"))).alias("rank"))
    return queries.select("query").distinct().join(best, "query", "left")


def hit_metrics(first: DataFrame, at: tuple[int, ...] = (1, 3, 5, 10), by: list[list[str]] | None = None) -> DataFrame:
    """n, hit@k and MRR; a query without a hit counts as 0. ``by``: grouping sets of columns of ``first``."""
    hits = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 4).alias(f"hit_{k}") for k in at]
    mrr = F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 4).alias("mrr")
    if not by:
        return first.agg(F.count("*").alias("n"), *hits, mrr)
    every = sorted({x for group in by for x in group})
    return first.groupingSets([[F.col(x) for x in group] for group in by], *(F.col(x) for x in every)).agg(F.count("*").alias("n"), *hits, mrr)
