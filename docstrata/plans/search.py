"""Queries of the text functions and of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from docstrata.functions import text as T
from docstrata.functions.term_counts import hashed
from docstrata.operators import evaluation, models, retrieval
from docstrata.operators.cells import CellIndex
from docstrata.operators.text_index import TextIndex
from docstrata.plans.adapters import MANIFEST, ORACLES, TURNS, manifest, query, table, turns
from docstrata.storage import exists, materialize, scratch

# Index versions of the given tables: written at the first search of an application, and read by all that follow.
_VERSIONS: dict[tuple[str, str, str], str] = {}


def _version(spark, d, name, write):
    """Where the named index version of the tables in ``d`` lies; ``write`` makes it if it is not there."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _VERSIONS or not exists(spark, _VERSIONS[key]):
        path = scratch(spark, name)
        write(path)
        _VERSIONS[key] = path
    return _VERSIONS[key]


def _text_index(spark, d, name, chunks):
    """The inverted index of ``chunks`` (chunk_id, lexical)."""
    return TextIndex(spark, _version(spark, d, name, lambda path: TextIndex(spark, path, "bigint").add(chunks(), "first")), "bigint")


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def sql_terms(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '{T.TERM}'), lambda x: NOT list_contains({STOP}, x))"


# Word characters and white space of any script, as the engines' own classes differ beyond ASCII.
WORD, SPACE = r"\p{L}\p{M}\p{N}\p{Pc}", r"\s\v\x{85}\p{Z}"


def sql_squeeze(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '[{SPACE}]+', ' ', 'g'), '^ | $', '', 'g')"


def sql_normalized(text: str) -> str:
    return sql_squeeze(f"regexp_replace(lower({text}), '[^{WORD}{SPACE}.-]', '', 'g')")


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(173), ''), '([{WORD}])-\n([{WORD}])', '\1\2', 'g'), '[ \t' || chr(160) || ']+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS clean FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query(ORACLES["clean_text"])
def clean_text_all(spark, d):
    """The same under the name that tests hold against plain Python."""
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query(f"WITH {MANIFEST} SELECT record_key, nullif(regexp_extract(title, 'EB-[0-9]{{4}}-[0-9]{{4}}'), '') AS in_title, coalesce(nullif(regexp_extract(text, 'EB-[0-9]{{4}}-[0-9]{{4}}'), ''), '12345') AS in_text FROM manifest")
def find_docket(spark, d):
    """The first case number of a title, and of a whole text (else of a sentence that has one)."""
    rows = manifest(spark, d)
    return rows.select("record_key", T.find_docket(F.col("title")).alias("in_title"), T.find_docket(F.col("text"), F.lit("see proceeding ID 12345 now")).alias("in_text"))


@query(f"SELECT doc_id, {sql_normalized('text')} AS q FROM documents")
def normalize_question(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_question(F.col("text")).alias("q"))


@query(ORACLES["normalize_question"])
def normalize_question_all(spark, d):
    """normalize_question over every document, whole."""
    return table(spark, d, "documents").select("doc_id", T.normalize_question(F.col("text")).alias("q"))


@query("SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80) AS name FROM pages")
def safe_name(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query("SELECT doc_id, 'v' || (doc_id % 3) || '__' || lower(replace(replace(split_part('org/' || source || '-Small.en-v1.5', '/', 2), '-', '_'), '.', '_')) AS version FROM documents")
def index_version_names(spark, d):
    model = F.concat(F.lit("org/"), "source", F.lit("-Small.en-v1.5"))
    return table(spark, d, "documents").select("doc_id", T.index_version(F.concat(F.lit("v"), F.col("doc_id") % 3), model).alias("version"))


@query(f"WITH {MANIFEST} SELECT record_key, array_to_string(list_filter([title, docket, nullif(CASE WHEN bad THEN '' ELSE record_type END, '')], lambda x: x IS NOT NULL), ' | ') AS context FROM manifest")
def context_header(spark, d):
    return manifest(spark, d).select("record_key", T.context_header(F.col("title"), F.col("docket"), F.when(F.col("bad"), "").otherwise(F.col("record_type"))).alias("context"))


@query("SELECT conv_id, turn, substr(sha256(conv_id || '|v1|' || turn), 1, 32) AS chunk_id FROM conversations")
def chunk_ids(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.chunk_id(F.col("conv_id").cast("string"), F.lit("v1"), F.col("turn")).alias("chunk_id"))


@query("SELECT conv_id, turn, array_to_string(list_filter(list_sort(list_distinct([turn + 1, conv_id % 7])), lambda x: x BETWEEN 1 AND 4), ',') AS cited FROM conversations")
def citation_parse(spark, d):
    answer = F.concat(F.lit("Approved ["), (F.col("turn") + 1).cast("string"), F.lit("]. Also [0 , "), (F.col("conv_id") % 7).cast("string"), F.lit("] and [99]."))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.citations(answer, F.lit(4)), ",").alias("cited"))


@query(f"SELECT count(DISTINCT ({sql_normalized(chr(39) + ' ' + chr(39) + ' || upper(text) || ' + chr(39) + '?' + chr(39))}, conv_id % 2)) AS keys FROM conversations")
def cache_key(spark, d):
    return _distinct_keys(table(spark, d, "conversations"))


@query(ORACLES["cache_key"])
def cache_key_all(spark, d):
    """cache_key over every turn."""
    return _distinct_keys(table(spark, d, "conversations"))


def _distinct_keys(rows):
    key = T.cache_key(F.concat(F.lit(" "), F.upper("text"), F.lit("?")), v=F.col("conv_id") % 2, k=F.lit(6))
    return rows.agg(F.countDistinct(key).alias("keys"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'p. ' || (doc_id % 9) ELSE 'pp. ' || (doc_id % 9) || '-' || (doc_id % 9 + doc_id % 3) END AS pages FROM documents")
def pages_label(spark, d):
    n = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", T.pages_label((n % 9).cast("string"), (n % 9 + n % 3).cast("string")).alias("pages"))


@query("SELECT n_regionkey, '| nation | key |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation GROUP BY 1")
def table_markdown(spark, d):
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    cells = F.concat(F.array(F.array(F.lit("nation"), F.lit("key"))), F.transform("r", lambda x: F.array(F.concat(F.lit(" "), x["n_name"], F.lit("  ")), x["n_nationkey"].cast("string"))))
    return rows.select("n_regionkey", T.table_to_markdown(cells).alias("md"))


@query(f"SELECT doc_id, array_to_string({sql_terms('text')}, ' ') AS terms FROM documents")
def doc_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.terms(F.col("text")), " ").alias("terms"))


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({sql_terms('text')})) AS term FROM documents) GROUP BY 1")
def doc_frequency(spark, d):
    return retrieval.document_frequency(table(spark, d, "documents"))


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("qtext"))


DF = f"df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({sql_terms('text')})) AS term FROM documents) GROUP BY 1), asked AS (SELECT DISTINCT item_id AS query_id, unnest({sql_terms('text')}) AS term FROM benchmark)"


@query(f"WITH {DF} SELECT query_id, term, df FROM asked JOIN df USING (term) WHERE df <= greatest(25, floor((SELECT count(*) FROM documents) * 0.005))")
def rare_terms(spark, d):
    docs = table(spark, d, "documents")
    return retrieval.rare_terms(_questions(spark, d), retrieval.document_frequency(docs), docs.count())


def sql_exact_terms(text: str) -> str:
    """Letters beyond ASCII count as word characters, and in no term of the given texts: as an underscore they end words as they do there."""
    plain = f"regexp_replace({text}, '[^\\x00-\\x7F]', '_', 'g')"
    found = f"list_filter(regexp_extract_all({plain}, '{T.EXACT_TERM}'), lambda x: upper(x) NOT IN ('OEB', 'THE'))"
    return f"list_sort(list_distinct(list_filter(list_transform({found}, lambda x: lower(trim(x, '.,'))), lambda x: x <> '')))"


@query(f"SELECT doc_id, array_to_string({sql_exact_terms('text')}, ' ') AS terms FROM documents")
def exact_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.exact_terms(F.col("text")), " ").alias("terms"))


@query(ORACLES["exact_terms"])
def exact_terms_all(spark, d):
    """exact_terms over every document."""
    return table(spark, d, "documents").select("doc_id", F.array_join(T.exact_terms(F.col("text")), " ").alias("terms"))


BM25 = f"""{DF}, words AS (SELECT doc_id AS chunk_id, {sql_terms('text')} AS terms FROM documents), stats AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM words),
tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(terms) AS dl, unnest(terms) AS term FROM words) GROUP BY ALL),
scores AS (SELECT a.query_id, t.chunk_id, round(sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.dl / s.avgdl))), 6) AS score
  FROM asked a JOIN tf t USING (term) JOIN df f USING (term), stats s GROUP BY ALL),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC) AS rank FROM scores QUALIFY rank <= 50)"""


def _document_index(spark, d):
    return _text_index(spark, d, "document-terms", lambda: table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("lexical")))


def _lexical(spark, d, n=50):
    asked = retrieval.question_terms(_questions(spark, d))
    return retrieval.bm25(_document_index(spark, d).postings(asked), asked, n)


@query(f"WITH {BM25} SELECT query_id, chunk_id, score, rank FROM lexical WHERE rank <= 10")
def bm25_topk(spark, d):
    return _lexical(spark, d, 10).withColumn("rank", F.col("rank").cast("long"))


DENSE = """qs AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label AS qlabel FROM embeddings WHERE vec_id % 50 = 0),
sims AS (SELECT query_id, vec_id AS chunk_id, round(list_inner_product(embedding::DOUBLE[], q) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q, q)) + 1e-9), 6) AS score FROM embeddings, qs{where}),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims QUALIFY rank <= 50)"""


def _dense(spark, d, n, **filters):
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return retrieval.dense_top(retrieval.filtered(rows, **filters).select(F.col("vec_id").alias("chunk_id"), "embedding"), asked, n)


@query(f"WITH {DENSE.format(where='')} SELECT query_id, chunk_id, score, rank FROM dense WHERE rank <= 6")
def dense_topk(spark, d):
    return _dense(spark, d, 6).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {DENSE.format(where=' WHERE label = 3')} SELECT query_id, chunk_id, score, rank FROM dense WHERE rank <= 6")
def dense_topk_filtered(spark, d):
    return _dense(spark, d, 6, label=3, date_from=None).withColumn("rank", F.col("rank").cast("long"))


@query()
def ann_topk(spark, d):
    """The nearest by cells: approximate, with the number of probes that finds 0.95 of the nearest of a sample; tests hold it against dense_topk."""
    rows = table(spark, d, "embeddings")

    def write(path):
        index = CellIndex(spark, path, "bigint")
        index.add(rows.select(F.col("vec_id").alias("chunk_id"), "embedding"), "first")
        index.tune()

    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return CellIndex(spark, _version(spark, d, "vector-cells", write), "bigint").search(asked, 6).withColumn("rank", F.col("rank").cast("long"))


LISTS = "a AS (SELECT item_id % 10 AS query_id, item_id AS chunk_id, row_number() OVER (PARTITION BY item_id % 10 ORDER BY length(text), item_id) AS rank FROM benchmark), b AS (SELECT item_id % 10 AS query_id, item_id AS chunk_id, row_number() OVER (PARTITION BY item_id % 10 ORDER BY item_id DESC) AS rank FROM benchmark WHERE item_id % 3 > 0)"


@query(f"""WITH {LISTS}, f AS (SELECT query_id, chunk_id, a.rank AS ra, b.rank AS rb, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score FROM a FULL JOIN b USING (query_id, chunk_id))
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ra NULLS LAST, rb NULLS LAST) AS rank FROM f QUALIFY rank <= 3""")
def rrf_fuse(spark, d):
    rows = table(spark, d, "benchmark").select((F.col("item_id") % 10).alias("query_id"), F.col("item_id").alias("chunk_id"), "text")
    first = retrieval.top(rows, 50, F.length("text"), F.asc("chunk_id"))
    second = retrieval.top(rows.where("chunk_id % 3 > 0"), 50, F.desc("chunk_id"))
    return retrieval.fuse([first, second], 3).withColumn("rank", F.col("rank").cast("long"))


# Search as the index has it: a chunk's text has its title before it, and a question may name a case.
def _pool(spark, d):
    rows = manifest(spark, d).select(F.col("doc_id").cast("long").alias("chunk_id"), "text", F.col("title").alias("context"), F.col("record_type").alias("lang"), "published_at")
    return rows.withColumn("lexical", F.concat_ws(" ", "context", "text"))


def _asked(spark, d):
    case = F.concat(F.lit(" in EB-2025-"), F.lpad((F.col("query_id") % 50).cast("string"), 4, "0"))
    rows = _questions(spark, d).withColumn("qtext", F.when(F.col("query_id") % 4 > 0, F.concat("qtext", case)).otherwise(F.col("qtext")))
    return rows.withColumn("qvec", retrieval.hash_embedding(F.col("qtext")))


def _search(spark, d, mode, k=6, **filters):
    """Over the index version of the pool: its vectors and its terms are written once, and a search reads them."""
    pool = _pool(spark, d)
    made = _version(spark, d, "pool-vectors", lambda path: hashed(pool.select("chunk_id", "lang", "published_at", "text")).write.parquet(path))
    vectors = retrieval.filtered(spark.read.parquet(made), **filters)
    index = _text_index(spark, d, "pool-terms", lambda: pool.select("chunk_id", "lexical")) if mode else None
    part = vectors.select("chunk_id") if any(filters.values()) else None
    asked = materialize(_asked(spark, d), "questions")
    found = retrieval.search(vectors, asked, k, mode, index.size() if mode == "rare" else None, index=index, part=part)
    # a few hits of known size, which go to the rows that they are joined with
    return materialize(found, "found")


def sql_vector(text: str) -> str:
    places = f"list_transform({sql_terms(text)}, lambda t: ('0x' || substr(md5(t), 1, 2))::INT % 64)"
    counts = f"list_transform([{places}], lambda of: list_transform(range(64), lambda i: len(list_filter(of, lambda x: x = i))::DOUBLE))[1]"
    return f"list_transform([{counts}], lambda v: list_transform(v, lambda x: CASE WHEN list_inner_product(v, v) > 0 THEN x / sqrt(list_inner_product(v, v)) ELSE 0 END))[1]"


def sql_search(mode: str | None, k: int, where: str = "true") -> str:
    """The tables of a search; the last one is ``found``."""
    asked = f"unnest(list_distinct({sql_terms('qtext')}))" if mode != "exact" else f"unnest(list_distinct(flatten(list_transform({sql_exact_terms('qtext')}, lambda t: {sql_terms('t')}))))"
    limit = "WHERE df <= greatest(25, floor((SELECT count(*) FROM documents) * 0.005))" if mode == "rare" else ""
    second = "lexical" if mode else "(SELECT * FROM lexical WHERE false)"
    return f"""{MANIFEST}, pool AS (SELECT doc_id::BIGINT AS chunk_id, text, title AS context, record_type AS lang, published_at FROM manifest WHERE {where}),
qs AS (SELECT item_id AS query_id, text || CASE WHEN item_id % 4 > 0 THEN ' in EB-2025-' || lpad((item_id % 50)::VARCHAR, 4, '0') ELSE '' END AS qtext FROM benchmark),
words AS (SELECT chunk_id, {sql_terms("context || ' ' || text")} AS terms FROM pool), stats AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM words),
tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(terms) AS dl, unnest(terms) AS term FROM words) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
asked AS (SELECT a.query_id, a.term, f.df FROM (SELECT query_id, {asked} AS term FROM qs) a JOIN df f USING (term) {limit}),
scores AS (SELECT a.query_id, t.chunk_id, round(sum(ln(1 + (s.n - a.df + 0.5) / (a.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.dl / s.avgdl))), 6) AS score FROM asked a JOIN tf t USING (term), stats s GROUP BY ALL),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC) AS rank FROM scores WHERE score > 0 QUALIFY rank <= 50),
vectors AS (SELECT chunk_id, {sql_vector('text')} AS v FROM pool), qvectors AS (SELECT query_id, {sql_vector('qtext')} AS q FROM qs),
sims AS (SELECT query_id, chunk_id, round(list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q)) + 1e-9), 6) AS score FROM vectors, qvectors),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims QUALIFY rank <= 50),
fused AS (SELECT query_id, chunk_id, a.rank AS ra, b.rank AS rb, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score FROM dense a FULL JOIN {second} b USING (query_id, chunk_id)),
found AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ra NULLS LAST, rb NULLS LAST) AS rank FROM fused QUALIFY rank <= {k})"""


def _shown(hits, spark, d):
    rows = _pool(spark, d).select("chunk_id", "lang")
    return retrieval.materialize_hits(hits.withColumn("rank", F.col("rank").cast("long")), rows).select("query_id", "chunk_id", "score", "rank", "lang")


SHOWN = "SELECT f.query_id, f.chunk_id, f.score, f.rank, p.lang FROM found f JOIN pool p USING (chunk_id)"


@query(f"WITH {sql_search('exact', 6)} {SHOWN}")
def hybrid_topk(spark, d):
    """Vectors of whole texts and the codes of a question, fused."""
    return _shown(_search(spark, d, "exact"), spark, d)


@query(f"WITH {sql_search('rare', 6)} {SHOWN}")
def hybrid_rare_topk(spark, d):
    """Vectors of whole texts and the rare terms of a question, fused."""
    return _shown(_search(spark, d, "rare"), spark, d)


@query(f"""WITH {sql_search("rare", 6).replace("WHERE true)", f"WHERE record_type = 'en' AND published_at >= '2026-01-20')")} {SHOWN}""")
def hybrid_rare_filtered(spark, d):
    """The same over part of the chunks: frequencies are those of the part, the threshold is that of all chunks."""
    return _shown(_search(spark, d, "rare", lang="en", date_from="2026-01-20", date_to=None), spark, d)


@query(f"WITH {sql_search(None, 6)} {SHOWN}")
def dense_mode_topk(spark, d):
    return _shown(_search(spark, d, None), spark, d)


HITS = f"{TURNS}, hits AS (SELECT * FROM turns WHERE ordinal = 2 OR (ordinal = 3 AND doc_id % 4 = 0))"


def _hits(spark, d):
    return turns(spark, d).where("ordinal = 2 OR (ordinal = 3 AND doc_id % 4 = 0)")


NEAR = "near AS (SELECT h.doc_id, h.ordinal, t.ordinal AS place, t.text, t.page_start, t.page_end FROM hits h JOIN turns t ON t.doc_id = h.doc_id AND t.ordinal BETWEEN h.ordinal - 1 AND h.ordinal + 1 AND t.ordinal <> h.ordinal AND t.chunk_type = 'text' WHERE NOT EXISTS (SELECT 1 FROM hits x WHERE x.doc_id = t.doc_id AND x.ordinal = t.ordinal))"


@query(f"WITH {HITS}, {NEAR} SELECT doc_id, ordinal, place, page_start FROM near")
def neighbors(spark, d):
    return retrieval.neighbours(_hits(spark, d), turns(spark, d)).select("doc_id", "ordinal", "place", "page_start")


@query(f"""WITH {HITS}, {NEAR}, line AS (SELECT n.doc_id, n.ordinal, n.place, unnest(string_split(n.text, chr(10))) AS line, generate_subscripts(string_split(n.text, chr(10)), 1) AS i FROM near n),
kept AS (SELECT l.* FROM line l JOIN hits h USING (doc_id, ordinal) WHERE NOT list_contains(string_split(h.text, chr(10)), l.line)),
sides AS (SELECT doc_id, ordinal, string_agg(line, chr(10) ORDER BY place, i) FILTER (place < ordinal) AS b, string_agg(line, chr(10) ORDER BY place, i) FILTER (place > ordinal) AS a FROM kept GROUP BY 1, 2)
SELECT h.doc_id, h.ordinal, coalesce(s.b || chr(10), '') || h.text || coalesce(chr(10) || s.a, '') AS context_text,
  least(h.page_start, (SELECT min(page_start) FROM near n WHERE n.doc_id = h.doc_id AND n.ordinal = h.ordinal)) AS page_start, greatest(h.page_end, (SELECT max(page_end) FROM near n WHERE n.doc_id = h.doc_id AND n.ordinal = h.ordinal)) AS page_end
FROM hits h LEFT JOIN sides s USING (doc_id, ordinal)""")
def neighbor_expand(spark, d):
    return retrieval.expand(_hits(spark, d), turns(spark, d)).select("doc_id", "ordinal", "context_text", "page_start", "page_end")


@query("SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def embed_cache_probe(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("text_hash"))
    cache = docs.where("doc_id % 3 = 0").select(F.lit("small").alias("model"), "text_hash").unionByName(docs.select(F.lit("other").alias("model"), "text_hash"))
    return retrieval.cache_misses(docs, cache, "small").select("text_hash")


@query(f"SELECT item_id AS query_id, array_to_string(list_transform({sql_vector('text')}, lambda x: (x * 1000000)::BIGINT), ',') AS vector FROM benchmark")
def hash_embedding(spark, d):
    """A stand-in embedder's vectors of the questions, in millionths."""
    return _questions(spark, d).select("query_id", F.array_join(F.transform(retrieval.hash_embedding(F.col("qtext")), lambda x: F.bround(x * 1_000_000).cast("long")), ",").alias("vector"))


def _reranked(spark, d):
    """The question's rare terms and vectors give candidates; another score chooses among them."""
    pool = _pool(spark, d).drop("lexical", "lang")
    hits = _search(spark, d, "rare", 20).join(pool, "chunk_id").join(_asked(spark, d).drop("qvec"), "query_id")
    return retrieval.rerank(hits, retrieval.overlap_score, 6)


RERANK = sql_search("rare", 20) + f""", pairs AS (SELECT h.*, list_distinct({sql_terms('b.qtext')}) AS q, {sql_terms("d.context || chr(10) || d.text")} AS t, d.text, b.qtext FROM found h JOIN pool d USING (chunk_id) JOIN qs b USING (query_id)),
reranked AS (SELECT query_id, chunk_id, score, text, qtext, round(len(list_intersect(q, t)) / greatest(len(q), 1)::DOUBLE, 6) AS rescored, row_number() OVER (PARTITION BY query_id ORDER BY round(len(list_intersect(q, t)) / greatest(len(q), 1)::DOUBLE, 6) DESC, rank) AS n FROM pairs QUALIFY n <= 6)"""


@query(f"WITH {RERANK} SELECT query_id, chunk_id, rescored, n AS rank FROM reranked")
def rerank_topk(spark, d):
    return _reranked(spark, d).select("query_id", "chunk_id", "rescored", F.col("rank").cast("long").alias("rank"))


ANSWER = rf"""{RERANK}, cut AS (SELECT query_id, qtext, n, generate_subscripts(parts, 1) AS place, unnest(parts) AS part FROM (SELECT *,
  string_split(regexp_replace(regexp_replace(text, '([.;:])[{SPACE}]+', '\1' || chr(1), 'g'), '\n([A-Z0-9(])', chr(1) || '\1', 'g'), chr(1)) AS parts FROM reranked WHERE n <= 4)),
tidy AS (SELECT query_id, qtext, n, place, {sql_squeeze('part')} AS s FROM cut),
scored AS (SELECT query_id, n, place, s, round(len(list_intersect(list_distinct({sql_terms('qtext')}), {sql_terms('s')})) / (1 + 0.1::DOUBLE * n), 9) AS score FROM tidy WHERE length(s) >= 25),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n, place) AS r FROM scored WHERE score > 0 QUALIFY r <= 3),
told AS (SELECT query_id, '(Extractive answer - no LLM configured.) ' || string_agg(s || ' [' || n || ']', ' ' ORDER BY r) AS answer, list_sort(list_distinct(list(n::INT))) AS cited FROM best GROUP BY 1)"""


@query(f"WITH {ANSWER} SELECT q.query_id, coalesce(t.answer, 'The retrieved filings do not appear to answer this question.') AS answer, coalesce(array_to_string(t.cited, ','), '') AS cited FROM (SELECT DISTINCT query_id FROM reranked) q LEFT JOIN told t USING (query_id)")
def extractive_answer(spark, d):
    # read twice, for sentences and for questions without any
    docs = materialize(_reranked(spark, d).select("query_id", "qtext", F.col("rank").alias("n"), F.col("text").alias("context_text")), "hits")
    return retrieval.extractive_answer(docs).withColumn("cited", F.array_join("cited", ","))


@query(f"WITH {RERANK} SELECT query_id, chunk_id, n, substr(text, 1, 300) AS snippet, strftime(DATE '2026-01-01' + (chunk_id % 90)::INTEGER, '%Y-%m-%d') AS date, round(score, 5) AS score FROM reranked")
def source_citations(spark, d):
    hits = _reranked(spark, d).withColumn("published_at", F.concat("published_at", F.lit("T00:00:00Z")))
    return retrieval.source_rows(hits).withColumn("n", F.col("n").cast("long"))


# evaluation: a question is an item of the benchmark, expected are the documents that hold it
EXPECTED = "expected AS (SELECT b.item_id AS question_id, d.doc_id AS source_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
FIRST = f"{BM25}, {EXPECTED}, hit AS (SELECT e.question_id, min(l.rank) AS first FROM expected e JOIN lexical l ON l.query_id = e.question_id AND l.chunk_id = e.source_id GROUP BY 1), firsts AS (SELECT DISTINCT e.question_id, h.first FROM expected e LEFT JOIN hit h USING (question_id))"


def _expected(spark, d):
    """Documents that hold an item: candidates by its rarest inner term, then the exact test; an item without inner terms meets every document.

    The first and the last term of an item may be parts of longer words of a document, an inner one stands there as it is.
    """
    items, docs = table(spark, d, "benchmark").where("text IS NOT NULL"), table(spark, d, "documents").select("doc_id", "text")
    found = F.regexp_extract_all(F.lower("text"), F.lit(T.TERM), F.lit(0))
    inner = F.filter(F.slice(found, 2, F.greatest(F.size(found) - 2, F.lit(0))), lambda t: ~t.isin(T.STOP_WORDS))
    needles = items.select("item_id", F.col("text").alias("needle"), F.array_distinct(inner).alias("terms"))
    # which documents have a term is what the index tells; no text is cut for that
    index, inner = _document_index(spark, d), needles.select("item_id", F.explode("terms").alias("term"))
    counted = inner.join(index.postings(inner).frequency(), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = materialize(counted.groupBy("item_id").agg(F.min_by("term", F.struct("df", "term")).alias("term")), "rarest")
    # texts join only the candidates, whose number is known
    pairs = materialize(index.postings(rarest).rows.select("term", F.col("chunk_id").alias("doc_id")).join(rarest, "term").select("item_id", "doc_id").join(needles.select("item_id", "needle"), "item_id"), "candidates")
    some = pairs.join(docs, "doc_id").where(F.contains("text", F.col("needle"))).select("item_id", "doc_id")
    # a stated set of items against all documents, one test for each; only the few short ones come here
    bare = needles.where(F.size("terms") == 0).select("item_id", "needle")
    every = docs.join(bare, F.contains(docs["text"], bare["needle"])).select("item_id", "doc_id")
    return some.unionByName(every).select(F.col("item_id").alias("question_id"), F.col("doc_id").alias("source_id"))


def _firsts(spark, d):
    results = _lexical(spark, d).select(F.col("query_id").alias("question_id"), "rank", F.col("chunk_id").alias("source_id"))
    return evaluation.first_ranks(results, _expected(spark, d))


@query(f"WITH {FIRST} SELECT question_id, first FROM firsts")
def eval_first_rank(spark, d):
    return _firsts(spark, d).withColumn("first", F.col("first").cast("long"))


@query(f"WITH {FIRST} SELECT count(*) AS n_questions, round(avg(coalesce(first <= 1, false)::INT), 6) AS hit_1, round(avg(coalesce(first <= 3, false)::INT), 6) AS hit_3, round(avg(coalesce(first <= 6, false)::INT), 6) AS hit_k, round(avg(coalesce(CASE WHEN first <= 6 THEN 1.0::DOUBLE / first END, 0)), 6) AS mrr FROM firsts")
def eval_summary(spark, d):
    return evaluation.summary(_firsts(spark, d))


@query(f"""WITH {ANSWER}, {EXPECTED}, right_ AS (SELECT q.query_id, coalesce(contains({sql_squeeze("lower(t.answer)")}, {sql_squeeze("lower(b.text)")}), false) AS answer_right FROM (SELECT DISTINCT query_id FROM reranked) q JOIN benchmark b ON b.item_id = q.query_id LEFT JOIN told t USING (query_id)),
cites AS (SELECT DISTINCT r.query_id FROM told t JOIN reranked r ON r.query_id = t.query_id AND list_contains(t.cited, r.n::INT) JOIN expected e ON e.question_id = r.query_id AND e.source_id = r.chunk_id)
SELECT count(*) AS n_questions, round(avg(answer_right::INT), 6) AS answer_acc, round(avg((c.query_id IS NOT NULL)::INT), 6) AS cited_expected_rate FROM right_ LEFT JOIN cites c USING (query_id)""")
def eval_answers(spark, d):
    """Whether extracted answers hold the item, and whether they cite a document that does."""
    hits = materialize(_reranked(spark, d), "hits")
    answers = retrieval.extractive_answer(hits.select("query_id", "qtext", F.col("rank").alias("n"), F.col("text").alias("context_text"))).withColumnRenamed("query_id", "question_id")
    items = _questions(spark, d).select(F.col("query_id").alias("question_id"), F.col("qtext").alias("needle"))
    said = answers.select("question_id", F.lit(1).alias("rank"), F.col("answer").alias("context"))
    right = evaluation.needle_ranks(said, items).select("question_id", F.col("answer_rank").isNotNull().alias("answer_right"))
    cited = answers.select("question_id", F.explode("cited").alias("rank")).join(hits.select(F.col("query_id").alias("question_id"), "rank", F.col("chunk_id").alias("source_id")), ["question_id", "rank"])
    cites = cited.join(_expected(spark, d), ["question_id", "source_id"], "left_semi").select("question_id", F.lit(True).alias("cited_expected")).distinct()
    rows = answers.select("question_id").join(right, "question_id", "left").join(cites, "question_id", "left").withColumn("cited_expected", F.coalesce("cited_expected", F.lit(False)))
    nothing = {c: F.lit(None).cast("long") for c in ("first", "answer_rank", "retrieval_ms", "total_ms", "read_tokens", "written_tokens", "input_tokens")}
    return evaluation.report(rows.withColumns({**nothing, "error": F.lit(None).cast("string")})).select("n_questions", "answer_acc", "cited_expected_rate")


@query(f"SELECT doc_id, array_to_string(list_transform({sql_vector('text')}, lambda x: (x * 1000000)::BIGINT), ',') AS vector FROM documents")
def batched_embedding(spark, d):
    """Vectors of whole documents by a model class behind Arrow batches, in millionths."""
    made = models.embedded(table(spark, d, "documents").select("doc_id", "text"), models.BatchModel("hash-64", models.HashEmbedder), "text")
    return made.select("doc_id", F.array_join(F.transform("embedding", lambda x: F.bround(x * 1_000_000).cast("long")), ",").alias("vector"))


@query(f"WITH {BM25} SELECT b.item_id AS question_id, min(l.rank) FILTER (contains(lower(regexp_replace(d.text, '\\s+', ' ', 'g')), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g'))))) AS answer_rank FROM benchmark b LEFT JOIN lexical l ON l.query_id = b.item_id AND l.rank <= 6 LEFT JOIN documents d ON d.doc_id = l.chunk_id GROUP BY 1")
def eval_answer_hits(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("context"))
    results = materialize(_lexical(spark, d, 6), "results").join(docs, "chunk_id").select(F.col("query_id").alias("question_id"), "rank", "context")
    needles = _questions(spark, d).select(F.col("query_id").alias("question_id"), F.col("qtext").alias("needle"))
    return evaluation.needle_ranks(results, needles).withColumn("answer_rank", F.col("answer_rank").cast("long"))


@query("SELECT o_orderpriority AS kind, list_sort(list(o_totalprice))[least(count(*), round_even(0.5::DOUBLE * (count(*) - 1), 0)::BIGINT + 1)] AS p50, list_sort(list(o_totalprice))[least(count(*), round_even(0.95::DOUBLE * (count(*) - 1), 0)::BIGINT + 1)] AS p95 FROM orders GROUP BY 1")
def eval_percentiles(spark, d):
    return evaluation.percentiles_nearest(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "kind"), "kind", "o_totalprice", p50=50, p95=95)


@query(f"WITH {DF} SELECT term, df FROM df")
def index_terms(spark, d):
    """Terms and their document frequencies from the inverted index."""
    return _document_index(spark, d).frequency()


@query(f"WITH {DF}, n AS (SELECT count(*) AS n FROM documents) SELECT greatest(25, floor(n * 0.005))::BIGINT AS threshold, count(*) AS terms, count(*) FILTER (df <= greatest(25, floor(n * 0.005))) AS rare FROM df, n GROUP BY 1")
def rare_threshold(spark, d):
    docs = table(spark, d, "documents")
    limit = F.greatest(F.lit(25).cast("long"), F.floor(F.lit(docs.count()) * 0.005))
    return retrieval.document_frequency(docs).agg(F.max(limit).alias("threshold"), F.count("*").alias("terms"), F.count_if(F.col("df") <= limit).alias("rare"))


@query("SELECT round(avg(quality), 6) AS accuracy, round(avg(toxic), 6) AS toxic_rate, count(*) AS n FROM labels JOIN documents USING (doc_id)")
def label_rates(spark, d):
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id")
    return joined.agg(F.round(F.avg("quality"), 6).alias("accuracy"), F.round(F.avg("toxic"), 6).alias("toxic_rate"), F.count("*").alias("n"))

