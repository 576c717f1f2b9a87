"""Dense, lexical and fused search over chunks; neighbours, reranking and extractive answers.

``chunks`` have chunk_id, text and, as needed, context, embedding, doc_id and ordinal; ``queries`` have query_id, qtext and qvec.
All searches take many queries at once. Ties are broken by id, so results are the same on every run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.functions.text import exact_terms, terms
from docstrata.storage import dealt, materialize

RRF_K = 60
CANDIDATES = 50
# Postings that a task puts in order at most, about.
POSTINGS = 1_000_000


def filtered(chunks: DataFrame, **filters) -> DataFrame:
    """Pre-filters before any scoring: equal columns, date_from and date_to; falsy values are no filter."""
    for name, value in filters.items():
        if not value:
            continue
        if name == "date_from":
            chunks = chunks.where(F.col("published_at") >= F.lit(value))
        elif name == "date_to":
            chunks = chunks.where(F.col("published_at") <= F.lit(value))
        else:
            chunks = chunks.where(F.col(name) == F.lit(value))
    return chunks


def top(scored: DataFrame, n: int, *order: Column, by: str = "query_id", rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    # the filter on row_number becomes a partial top-n in each task before the shuffle
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, t: s + t))
    return dot / (norm(a) * norm(b) + F.lit(1e-9))


def _best(ids: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n best of one query: the highest scores, equal ones by id."""
    if len(scores) > n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        near = scores >= least  # with all that tie with the last one
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:n]
    return ids[order], scores[order]


def _dense(asked: pa.Table, n: int, scores_at_once: int = 1 << 21):
    """Per task, the n best chunks of each query: matrix products of bounded size, and what was best so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.array(asked["qvec"].to_pylist(), dtype=np.float64)
        norm = np.sqrt((q * q).sum(axis=1))
        width, least, kept = len(q), None, None
        for whole in batches:
            for batch in (whole.slice(a, rows) for rows in [max(1, scores_at_once // width)] for a in range(0, whole.num_rows, rows)):
                ids, x = _usable(batch, q.shape[1])
                if not len(x):
                    continue
                scores = q @ x.T
                scores /= norm[:, None] * np.sqrt((x * x).sum(axis=1)) + 1e-9
                np.round(scores, 6, out=scores)
                # one place among the kept for each query; what is no better than the last one there is left out
                if kept is None:
                    kind, kept, least = batch.column("chunk_id").type, (np.zeros(0, np.int64), ids[:0], np.zeros(0)), np.full(width, -np.inf)
                if np.isneginf(least).any() and len(ids) > n:
                    least = np.maximum(least, np.nan_to_num(np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n], nan=-np.inf))
                own, at = np.nonzero(~(scores < least[:, None]))
                kept = tuple(np.concatenate([a, c]) for a, c in zip(kept, (own, ids[at], scores[own, at])))
                by = np.lexsort((kept[1], -kept[2], kept[0]))
                begin = np.searchsorted(kept[0][by], np.arange(width + 1))
                by = by[np.arange(len(by)) - begin[kept[0][by]] < n]
                kept = tuple(a[by] for a in kept)
                sizes = np.bincount(kept[0], minlength=width)
                full = sizes >= n
                least = np.where(full, np.nan_to_num(kept[2][np.cumsum(sizes) - 1], nan=-np.inf), -np.inf)
        if kept is not None:
            query = asked["query_id"].combine_chunks().take(pa.array(kept[0]))
            yield pa.RecordBatch.from_arrays([query, pa.array(kept[1], kind), pa.array(kept[2])], names=["query_id", "chunk_id", "score"])

    return run


def _usable(batch: pa.RecordBatch, dim: int, column: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows that have a whole vector of that length."""
    good = pc.equal(pc.list_value_length(batch.column(column)), dim).fill_null(False)
    batch = batch.filter(good)
    flat = batch.column(column).flatten()
    if flat.null_count:
        whole = np.ones(batch.num_rows, bool)
        whole[np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)) // dim] = False
        batch = batch.filter(pa.array(whole))
        flat = batch.column(column).flatten()
    return batch.column("chunk_id").to_numpy(zero_copy_only=False), flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def dense_top(chunks: DataFrame, queries: DataFrame, n: int = CANDIDATES, block: int = 4096) -> DataFrame:
    """query_id, chunk_id, score, rank by cosine similarity, exact. queries: query_id, qvec; a stated query set.

    Queries are counted and go to the tasks in blocks of about ``block``, one after another if there are more: a block is on the driver at a time, and costs one
    scan of the chunks and products of bounded size; only the n best of a task for a query leave it. Chunks without a vector, or with one of another
    length than the first query's, are not found.
    """
    spark = chunks.sparkSession
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", chunks.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())])
    asked = queries.where(F.col("qvec").isNotNull()).select("query_id", "qvec")
    blocks, parts = max(1, -(-asked.count() // block)), []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        if not own.num_rows:
            continue
        # what is usable is seen in the batches: a filter here would make the vectors once more
        scored = top(chunks.select("chunk_id", "embedding").mapInArrow(_dense(own, n), schema), n, F.desc("score"), F.asc("chunk_id"))
        parts.append(scored if blocks == 1 else materialize(scored, "dense"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], T.StructType([*schema, T.StructField("rank", T.IntegerType())]))


def document_frequency(chunks: DataFrame, text: str = "text") -> DataFrame:
    """term, df: in how many chunks a term occurs."""
    return chunks.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def rare_terms(queries: DataFrame, df: DataFrame, n_chunks: Column | int, share: float = 0.005, floor: int = 25) -> DataFrame:
    """Terms of the queries (query_id, qtext) that few chunks have, but at least one."""
    limit = rare_limit(n_chunks, share, floor)
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("qtext")))).alias("term"))
    return asked.join(df, "term").where((F.col("df") > 0) & (F.col("df") <= limit)).select("query_id", "term", "df")


@dataclass
class Postings:
    """Where asked terms occur (chunk_id, dl, term, tf); ``stats`` has one row: n, avgdl. ``few``: the asked terms were counted, and are few enough to be broadcast."""

    rows: DataFrame
    stats: DataFrame
    few: bool = False
    counts: DataFrame | None = None

    def frequency(self) -> DataFrame:
        """term, df of the asked terms that occur."""
        return self.counts if self.counts is not None else self.rows.groupBy("term").agg(F.count("*").alias("df"))

    def rare(self, asked: DataFrame, n_chunks: Column | int, share: float = 0.005, floor: int = 25) -> DataFrame:
        """The asked (query_id, term) that occur, but in no more chunks than the threshold, which is a share of ``n_chunks``: of all chunks, filtered or not."""
        return asked.join(self.frequency().where(F.col("df") <= rare_limit(n_chunks, share, floor)), "term").select("query_id", "term")


def rare_limit(n_chunks: Column | int, share: float = 0.005, floor: int = 25) -> Column:
    return F.greatest(F.lit(floor).cast("long"), F.floor((n_chunks if isinstance(n_chunks, Column) else F.lit(n_chunks)) * F.lit(share)))


def postings(chunks: DataFrame, asked: DataFrame, text: str = "text") -> Postings:
    """Texts are scanned and cut into terms once, whatever is asked of the postings; those of asked terms only are written.

    Each chunk also has a posting of the empty term, which no text has: their number and lengths are the statistics.
    """
    words = chunks.select("chunk_id", terms(F.col(text)).alias("terms"))
    wanted = asked.select("term").unionByName(chunks.sparkSession.createDataFrame([("",)], "term string")).distinct()
    found = words.select("chunk_id", F.size("terms").alias("dl"), F.explode(F.concat("terms", F.array(F.lit("")))).alias("term")).join(wanted, "term", "left_semi")
    held = materialize(found.groupBy("chunk_id", "term", "dl").agg(F.count("*").alias("tf")), "postings")
    return Postings(held.where("term <> ''"), held.where("term = ''").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def question_terms(queries: DataFrame, mode: str = "all") -> DataFrame:
    """Distinct (query_id, term) of the queries: all their terms, or with mode ``exact`` those of codes, amounts, years and acronyms."""
    if mode == "exact":
        # a code may be several terms
        words = F.flatten(F.transform(exact_terms(F.col("qtext")), terms))
    else:
        words = terms(F.col("qtext"))
    return queries.select("query_id", F.explode(F.array_distinct(words)).alias("term"))


def bm25(found: Postings, asked: DataFrame, n: int = CANDIDATES, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, chunk_id, score, rank. asked: distinct (query_id, term), all of them asked of the postings. Scores are summed map-side first."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    if found.few:
        return _bm25_of_few(found, asked, n, k1, b)
    # the statistics are one row
    weighted = found.rows.join(found.frequency(), "term").join(F.broadcast(found.stats)).withColumn("idf", idf).select("term", "chunk_id", weight.alias("w"))
    scores = asked.join(weighted, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum("w"), 6).alias("score")).where("score > 0")
    return top(scores, n, F.desc("score"), F.desc("chunk_id"))


def _bm25_of_few(found: Postings, asked: DataFrame, n: int, k1: float, b: float) -> DataFrame:
    """The same for counted, few asked terms: the postings of a chunk come together, and a task scores some chunks at a time for all queries and keeps the n best of each."""
    pairs = asked.join(found.frequency(), "term").select("query_id", "term", "df").toArrow()
    stats = found.stats.first()
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("chunk_id", found.rows.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())])
    if not pairs.num_rows or not stats["n"]:
        return found.rows.sparkSession.createDataFrame([], T.StructType([*schema, T.StructField("rank", T.IntegerType())]))
    # of the postings' terms, the ones that are asked here
    own = found.rows.where(F.col("term").isin(pairs["term"].unique().to_pylist()))
    counted = sum(pc.cast(pairs.group_by("term").aggregate([("df", "min")])["df_min"], pa.int64()).to_pylist())
    parts = dealt(own.select("chunk_id", "term", "dl", "tf"), 1 + counted // POSTINGS, "chunk_id").sortWithinPartitions("chunk_id", "term")
    return top(parts.mapInArrow(_bm25(pairs, stats["n"], stats["avgdl"], n, k1, b), schema), n, F.desc("score"), F.desc("chunk_id"))


def _bm25(pairs: pa.Table, n_chunks: int, avgdl: float, n: int, k1: float, b: float, cells: int = 1 << 21):
    """Per task, the n best chunks of each query of ``pairs`` (query_id, term, df), from postings in the order of their chunks; of equal scores the larger id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, names = (pairs[c].combine_chunks().dictionary_encode() for c in ("query_id", "term"))
        ask, term = queries.indices.to_numpy(), names.indices.to_numpy()
        width, order = len(queries.dictionary), np.argsort(term, kind="stable")
        ask, begin = ask[order], np.searchsorted(term[order], np.arange(len(names.dictionary) + 1))
        df = pairs["df"].to_numpy()[order][begin[:-1]]
        idf = np.log(1 + (n_chunks - df + 0.5) / (df + 0.5))
        # chunks at a time: so many that neither their scores nor their summands are more than stated
        most = max(1, min(cells // width, 4 * cells // len(ask)))
        ids, own, place, scores, seen = None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
        least = np.zeros(width)

        def score(rows: pa.Table) -> None:
            nonlocal ids, own, place, scores, seen
            chunk = rows["chunk_id"].combine_chunks()
            new = np.ones(len(chunk), bool)
            new[1:] = pc.not_equal(chunk[1:], chunk[:-1]).to_numpy(zero_copy_only=False)
            doc, first = np.cumsum(new) - 1, np.flatnonzero(new)
            t, tf, dl = pc.index_in(rows["term"].combine_chunks(), names.dictionary).to_numpy(zero_copy_only=False), rows["tf"].to_numpy(), rows["dl"].to_numpy()
            w = idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
            times = begin[t + 1] - begin[t]
            at = np.repeat(begin[t] - np.cumsum(times) + times, times) + np.arange(times.sum())
            docs = len(first)
            sums = np.round(np.bincount(ask[at].astype(np.int64) * docs + np.repeat(doc, times), np.repeat(w, times), width * docs), 6).reshape(width, docs)
            q, d = np.nonzero((sums > 0) & (sums >= least[:, None]))
            found = chunk.take(pa.array(first[d]))
            ids = pa.concat_arrays([ids, found]) if ids is not None else found
            own, place, scores = np.concatenate([own, q]), np.concatenate([place, seen + d]), np.concatenate([scores, sums[q, d]])
            seen += docs
            by = np.lexsort((-place, -scores, own))
            begins = np.searchsorted(own[by], np.arange(width + 1))
            rank = np.arange(len(by)) - begins[own[by]]
            by = by[rank < n]
            ids, own, place, scores = ids.take(pa.array(by)), own[by], place[by], scores[by]
            full = np.flatnonzero(np.bincount(own, minlength=width) >= n)
            least[full] = scores[np.searchsorted(own, full, side="right") - 1]

        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None and rest.num_rows else rows
            chunk = rows["chunk_id"].combine_chunks()
            ends = 1 + np.flatnonzero(pc.not_equal(chunk[1:], chunk[:-1]).to_numpy(zero_copy_only=False))
            # the last chunk may go on in the next batch
            done = 0
            for end in [*ends[most - 1 :: most].tolist(), *ends[-1:].tolist()]:
                if end > done:
                    score(rows.slice(done, end - done))
                    done = end
            rest = rows.slice(done)
        if rest is not None and rest.num_rows:
            score(rest)
        if ids is not None:
            yield pa.RecordBatch.from_arrays([queries.dictionary.take(pa.array(own)), ids, pa.array(scores)], names=["query_id", "chunk_id", "score"])

    return run


def bm25_top(chunks: DataFrame, asked: DataFrame, n: int = CANDIDATES, k1: float = 1.2, b: float = 0.75, text: str = "text") -> DataFrame:
    """query_id, chunk_id, score, rank. asked: distinct (query_id, term). Statistics are those of the given chunks."""
    return bm25(postings(chunks, asked, text), asked, n, k1, b)


def search(pool: DataFrame, queries: DataFrame, k: int, lexical: str | None = None, n_chunks: int | None = None, candidates: int = CANDIDATES, index=None, part: DataFrame | None = None, dense: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: the dense list, alone or fused with a lexical one.

    pool: chunk_id, embedding and ``lexical`` (the searched text), filtered as wanted; queries: query_id, qtext, qvec. ``lexical``: ``exact``
    for the codes of a question, ``rare`` for its terms that few of ``n_chunks`` chunks have (all of the index; of the pool, if not told).
    ``index``: a TextIndex of the pool's ``lexical``, or of more, with ``part`` the pool's ids then; without one the pool's texts are cut into terms. ``dense``: another
    search by vectors (queries, how many), over cells say.
    """
    if lexical not in (None, "exact", "rare"):
        raise ValueError(f"lexical must be exact, rare or None, not {lexical!r}")
    most = max(candidates, k)
    lists = [dense(queries, most) if dense else dense_top(pool, queries, most)]
    if lexical:
        asked = question_terms(queries, "exact" if lexical == "exact" else "all")
        found = index.postings(asked, part) if index else postings(pool, asked, "lexical")
        if lexical == "rare":
            asked = found.rare(asked, pool.count() if n_chunks is None else n_chunks)
        lists.append(bm25(found, asked, most))
    return fuse(lists, k)


def fuse(rankings: list[DataFrame], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, chunk_id, rank) lists; ties by the rank in the first list, then the next."""
    tagged = [r.select("query_id", "chunk_id", *(F.col("rank").alias(f"r{j}") if i == j else F.lit(None).cast("int").alias(f"r{j}") for j in range(len(rankings)))) for i, r in enumerate(rankings)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    ranks = [f"r{j}" for j in range(len(rankings))]
    one = rows.groupBy("query_id", "chunk_id").agg(*(F.max(r).alias(r) for r in ranks))
    score = sum((F.coalesce(1.0 / (rrf_k + F.col(r)), F.lit(0.0)) for r in ranks[1:]), F.coalesce(1.0 / (rrf_k + F.col("r0")), F.lit(0.0)))
    scored = one.withColumn("score", F.round(score, 9))
    return top(scored, k, F.desc("score"), *(F.asc_nulls_last(r) for r in ranks)).drop(*ranks)


def materialize_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the chunks' columns: wide rows are read for the few hits only, which are the broadcast side if small."""
    return chunks.join(hits, "chunk_id")


def neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """(doc_id, ordinal, place, text, page_start, page_end): text chunks next to each hit that are no hits themselves."""
    steps = [d for d in range(-window, window + 1) if d]
    if not steps:
        return hits.select("doc_id", "ordinal").join(chunks.select("doc_id", F.col("ordinal").alias("place"), "text", "page_start", "page_end"), "doc_id").where("false")
    places = hits.where("ordinal IS NOT NULL").select("doc_id", "ordinal", F.explode(F.array(*map(F.lit, steps))).alias("step")).withColumn("place", F.col("ordinal") + F.col("step"))
    free = places.join(hits.select("doc_id", F.col("ordinal").alias("place")), ["doc_id", "place"], "left_anti")
    other = chunks.where("chunk_type = 'text'").select("doc_id", F.col("ordinal").alias("place"), "text", "page_start", "page_end")
    return free.join(other, ["doc_id", "place"]).select("doc_id", "ordinal", "place", "text", "page_start", "page_end")


def expand(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Hits with context_text: lines of the neighbours that the hit lacks, before and after it, and the widened pages."""
    near = neighbours(hits, chunks, window).select("doc_id", "ordinal", F.struct("place", "text", "page_start", "page_end").alias("nb"))
    grouped = near.groupBy("doc_id", "ordinal").agg(F.array_sort(F.collect_list("nb")).alias("nbs"))
    joined = hits.join(grouped, ["doc_id", "ordinal"], "left").withColumn("nbs", F.coalesce("nbs", F.expr("cast(array() AS array<struct<place:bigint,text:string,page_start:bigint,page_end:bigint>>)")))
    core = F.split("text", "\n")
    lines = lambda side: F.flatten(F.transform(F.filter("nbs", side), lambda b: F.filter(F.split(b["text"], "\n"), lambda x: ~F.array_contains(core, x))))
    whole = F.array_join(F.concat(lines(lambda b: b["place"] < F.col("ordinal")), F.array("text"), lines(lambda b: b["place"] > F.col("ordinal"))), "\n")
    first = F.array_min(F.concat(F.array("page_start"), F.transform("nbs", lambda b: b["page_start"])))
    last = F.array_max(F.concat(F.array("page_end"), F.transform("nbs", lambda b: b["page_end"])))
    return joined.withColumn("context_text", whole).withColumn("page_start", first).withColumn("page_end", last).drop("nbs")


def rerank(hits: DataFrame, score: Callable[[DataFrame], Column], k: int, rank: str = "rank") -> DataFrame:
    """The k best hits of each query by another score; equal scores stay in the order of the first rank.

    ``score`` gets the hits (with qtext, context, text) and returns a column: built-in functions or a pandas UDF; or it is a BatchModel for pairs.
    """
    from docstrata.operators.models import rescored

    scored = rescored(hits, score).withColumnRenamed(rank, "first_rank")
    return top(scored, k, F.desc("rescored"), F.asc("first_rank"), rank=rank)


def overlap_score(hits: DataFrame) -> Column:
    """A stand-in scorer without a model: the share of the question's terms that context and text have."""
    asked, have = F.array_distinct(terms(F.col("qtext"))), terms(F.concat_ws("\n", F.coalesce("context", F.lit("")), "text"))
    return F.round(F.size(F.array_intersect(asked, have)) / F.greatest(F.size(asked), F.lit(1)), 6)


def sentences(text: Column) -> Column:
    return F.transform(F.split(text, r"(?U)(?<=[.;:])\s+|\n(?=[A-Z0-9(])"), lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))


def extractive_answer(docs: DataFrame, most_docs: int = 4, most: int = 3, shortest: int = 25) -> DataFrame:
    """query_id, answer, cited: the sentences with most question terms, best first, with their document's number.

    docs: query_id, qtext, n (the document's number from 1), context_text. A fixed line where nothing fits.
    """
    rows = docs.where(F.col("n") <= most_docs).select("query_id", "qtext", "n", F.posexplode(sentences(F.col("context_text"))).alias("at", "s"))
    hits = F.size(F.array_intersect(F.array_distinct(terms(F.col("qtext"))), terms(F.col("s"))))
    scored = rows.where(F.length("s") >= shortest).withColumn("overlap", hits).where("overlap > 0").withColumn("score", F.round(F.col("overlap") / (1 + 0.1 * F.col("n")), 9))
    best = top(scored, most, F.desc("score"), F.asc("n"), F.asc("at"))
    picked = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "s", "n"))).alias("best"))
    text = F.array_join(F.transform("best", lambda b: F.concat(b["s"], F.lit(" ["), b["n"], F.lit("]"))), " ")
    answers = picked.select("query_id", F.concat(F.lit("(Extractive answer - no LLM configured.) "), text).alias("answer"), F.array_sort(F.array_distinct(F.transform("best", lambda b: b["n"]))).alias("cited"))
    none = F.lit("The retrieved filings do not appear to answer this question.")
    return docs.select("query_id").distinct().join(answers, "query_id", "left").select("query_id", F.coalesce("answer", none).alias("answer"), F.coalesce("cited", F.expr("cast(array() AS array<int>)")).alias("cited"))


def source_rows(hits: DataFrame) -> DataFrame:
    """What an answer shows of its sources."""
    return hits.select("query_id", F.col("rank").alias("n"), "chunk_id", F.substring("published_at", 1, 10).alias("date"), F.round("score", 5).alias("score"), F.substring("text", 1, 300).alias("snippet"))


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A stand-in embedder without a model: counts of terms by hash, scaled to length 1. The text is cut into terms once.

    The terms' places become one string with a character for each term, so that counting a place is a plain search in it.
    """
    if not 0 < dim <= 64:
        raise ValueError("there are 64 places at most")
    digit = lambda h, i: F.instr(F.lit("123456789abcdef"), F.substring(h, i, 1))
    place = lambda h: F.char((digit(h, 1) * 16 + digit(h, 2)) % dim + 48)
    hashes = F.transform(terms(text), lambda t: F.substring(F.md5(t.cast("binary")), 1, 2))
    # an array of one string, so that it has a name and is not made anew for each place
    once = F.array(F.array_join(F.transform(hashes, place), ""))
    count = lambda s, i: (F.length(s) - F.length(F.replace(s, F.char(i + 48), F.lit("")))).cast("double")
    counts = F.transform(once, lambda s: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: count(s, i)))
    norm = lambda raw: F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    named = F.transform(counts, lambda raw: F.struct(raw.alias("raw"), norm(raw).alias("norm")))
    return F.element_at(F.transform(named, lambda r: F.transform(r["raw"], lambda x: F.when(r["norm"] > 0, x / r["norm"]).otherwise(0.0))), 1)


def cache_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct hashes that the embedding cache lacks for the model, short texts first inside a task (less padding)."""
    have = cache.where(F.col("model") == model).select("text_hash")
    return texts.dropDuplicates(["text_hash"]).join(have, "text_hash", "left_anti").sortWithinPartitions(F.length("text"))
