"""The whole run over a lake: land, validate, gate, parse and route, chunk, gate, index, search, answer, evaluate.

Every step reads what is published and appends what is new, under deterministic keys: a step that ran
before does nothing, and one that failed is run again. A batch that fails validation is not published.
"""

from __future__ import annotations

import hashlib
import json
import logging
import signal
import threading
import time
from collections.abc import Callable
from datetime import UTC, datetime
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.config import settings
from docstrata.functions.text import cache_key, chunk_id, context_header, find_docket, index_version
from docstrata.operators import evaluation, marts, pages, quality, retrieval, silver
from docstrata.operators.chunking import Chunking, chunk_pages
from docstrata.operators.models import BatchModel, embedded, judged, rescored
from docstrata.operators.text_index import TextIndex
from docstrata.sources import lake as lakes
from docstrata.storage import exists, materialize
from docstrata.streaming import marks

log = logging.getLogger(__name__)
MODES = {"dense": None, "hybrid": "exact", "rerank": "rare"}
EXTRA = {
    "bronze/objects": "object_uri string, content binary, run_id string",
    "bronze/reports": "source string, status string, listed long, landed long, fetch_errors long, validated_at string, checks_json string, run_id string",
    "bronze/runs": "source string, run_id string, status string, registered_at string",
    "bronze/failed": "record_key string, name string, run_id string",
    "staging/pages": "record_key string, page_no int, text string, tables array<string>, n_pages_total int, raw boolean, error string, run_id string",
    "gold/chunks": "index_version string, chunk_id string, doc_id string, ordinal int, chunk_type string, page_start int, page_end int, section string, text string, context string, source string, source_id string, title string, docket string, published_at string, url string, embedding array<double>, run_id string",
    "gold/embeddings": "model string, text_hash string, embedding array<double>, run_id string",
    "gold/answers": "key string, created_at string, answer string, cited array<int>, run_id string",
    "gold/versions": "index_version string, chunk_config_version string, model string, created_at string, activated_at string, is_active boolean, n_chunks long, run_id string",
}
_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "array<double>": T.ArrayType(T.DoubleType()), "array<string>": T.ArrayType(T.StringType()), "array<int>": T.ArrayType(T.IntegerType())}
lakes.SCHEMAS |= {k: T.StructType([T.StructField(n, _KINDS[t]) for n, t in map(str.split, v.split(", "))]) for k, v in EXTRA.items()}
lakes.PARTITIONS["gold/chunks"] = ["index_version", "run_id"]


class GateError(RuntimeError):
    """A gate has stopped the run; the message says which and why."""


class Pipeline:
    def __init__(self, lake: lakes.Lake, given: dict | None = None, chunking: Chunking | None = None) -> None:
        self.lake, self.settings, self.chunking = lake, settings(given), chunking or Chunking()

    def _fit(self, df: DataFrame, table: str) -> DataFrame:
        return df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in lakes.SCHEMAS[table]))

    # bronze
    def ingest(self, listed: DataFrame, run_id: str, now: str, fetch_errors: int = 0, errors: DataFrame | None = None) -> dict:
        """listed: record columns and ``content`` (binary); errors: source, source_id, url, error of what could not be fetched. Returns the batch's status and counts."""
        v = self.settings["validation"]
        if errors is not None:
            failed = errors.withColumn("error", F.substring("error", 1, 500)).withColumn("failed_at", F.lit(now)).withColumn("run_id", F.lit(run_id))
            self.lake.append("bronze/fetch_errors", self._fit(failed, "bronze/fetch_errors"))
            fetch_errors += errors.count()
        # a run that is done again lands what it has landed before, in its place
        known = self.lake.read("bronze/manifest").where(F.col("run_id") != run_id)
        fresh = silver.new_listings(listed, known, ["source", "source_id"], ["registered_at"])
        landed = lakes.land(fresh, run_id, now[:10]).withColumn("fetched_at", F.lit(now)).withColumn("record_key", F.concat_ws(":", "source", "source_id")).cache()
        try:
            counts = {"listed": listed.count(), "landed": landed.count()}
            before = self.lake.read("bronze/reports").where(F.col("run_id") != run_id)
            limits = {k: v[k] for k in ("min_bytes", "max_bytes", "max_error_rate", "drop_ratio")}
            report = quality.batch_report(landed, ["record_key"], F.lit(now[:10]).cast("date"), fetch_errors, v["stale_days"], before, counts["listed"], **limits)
            checks = [r.asDict() for r in report.collect()]  # one row for each check
            bad = {c["severity"] for c in checks if not c["passed"]}
            status = "failed" if "error" in bad else "warn" if bad else "passed"
            counts = {"status": status, **counts}
            row = self.lake.spark.createDataFrame([(None, status, counts["listed"], counts["landed"], fetch_errors, now, json.dumps(checks), run_id)], lakes.SCHEMAS["bronze/reports"])
            self.lake.append("bronze/reports", row)
            if status != "failed":
                # readers see the run's three parts at once, by its commit
                self.lake.begin(run_id)
                self.lake.append("bronze/failed", quality.failed_records(landed, ["record_key"], v["min_bytes"], v["max_bytes"]).withColumn("run_id", F.lit(run_id)))
                self.lake.append("bronze/objects", self._fit(landed.where("duplicate_of IS NULL"), "bronze/objects"))
                self.lake.append("bronze/manifest", self._fit(landed, "bronze/manifest"))
                self.lake.commit(run_id)
            # last, so that a mark never moves before its records are there: a row for each source of the run
            run = landed.groupBy("source").agg(F.max("registered_at").alias("registered_at")).select("source", F.lit(run_id).alias("run_id"), F.lit(status).alias("status"), "registered_at")
            self.lake.append("bronze/runs", run)
        finally:
            landed.unpersist()
        return counts

    def watermark(self) -> DataFrame:
        """The high-water mark of each source, moved by the runs that have passed since it was asked for last; the manifest is not read."""
        if not exists(self.lake.spark, self.lake.path("bronze/runs")):
            return marks.marks(self.lake.spark, self.lake.path("state/marks"))
        return marks.advance(self.lake.spark, self.lake.path("bronze/runs"), self.lake.path("state/marks"))

    # silver
    def silver(self, run_id: str, now: str, chunk: bool = True) -> dict:
        """Parse and route what is new; with ``chunk``, cut it into chunks, too."""
        s, lake = self.settings["silver"], self.lake
        key = F.concat_ws(":", "source", "source_id")
        listed = lake.read("bronze/manifest").withColumn("record_key", key)
        work = silver.todo(listed, lake.read("silver/documents"), lake.read("silver/quarantine"))
        bad = lake.read("bronze/failed", "record_key").distinct()
        files = work.join(bad, "record_key", "left_anti").join(lake.read("bronze/objects", "object_uri", "content"), "object_uri")
        parsed = pages.parse_files(files.withColumn("key", F.col("record_key")), s["max_pages"])
        # parsing is the expensive part: its result is written once and read by all that follows
        lake.append("staging/pages", parsed.withColumnRenamed("key", "record_key").withColumn("run_id", F.lit(run_id)))
        found = pages.finished(lake.read("staging/pages").where(F.col("run_id") == run_id))
        text = found.groupBy("record_key").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n").alias("text"),
            F.count("page_no").cast("int").alias("n_pages"),
            F.max("n_pages_total").alias("n_pages_total"),
            F.sum(F.coalesce(F.size("tables"), F.lit(0))).cast("int").alias("n_tables"),
            F.max("error").alias("error"),
        )
        rows = work.join(text, "record_key", "left")
        # a record that could not be parsed has no text; its reason is the parser's
        routed = silver.route(rows, bad, self._existing(), s["min_text_chars"]).withColumn("run_id", F.lit(run_id))
        parse_failed = F.col("error").isNotNull() & (F.col("status") == "quarantined")
        routed = routed.withColumn("reason", F.when(parse_failed & (F.col("stage") == "parse"), F.col("error")).otherwise(F.col("reason")))
        landing = F.coalesce(F.get_json_object("extra_json", "$.landing_url"), F.col("url"))
        docs = routed.where("status <> 'quarantined'").withColumn("docket", F.coalesce("docket", find_docket(F.substring("text", 1, 5000)))).withColumn("landing_url", landing)
        docs = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("parser", F.col("extension")).withColumn("parsed_at", F.lit(now))
        # pages go first and documents last: a run that stops between them is done again as a whole
        ok = docs.where("status = 'ok'").select("record_key", "doc_id")
        full = pages.with_headings(found.where("page_no IS NOT NULL").join(ok, "record_key"))
        stored = full.withColumn("headings_json", F.to_json("headings")).withColumn("tables_json", F.to_json("tables"))
        lake.append("silver/pages", self._fit(stored, "silver/pages"))
        lake.append("silver/quarantine", self._fit(routed.where("status = 'quarantined'").withColumn("quarantined_at", F.lit(now)), "silver/quarantine"))
        # counted while they are written
        seen = Observation("silver")
        status = F.col("status")
        watched = self._fit(docs, "silver/documents").observe(seen, F.count_if(status == "ok").alias("ok"), F.count_if(status == "duplicate").alias("duplicate"), F.count_if((status == "ok") & F.col("n_pages").isNull()).alias("without_pages"))
        lake.append("silver/documents", watched)
        lake.clear("staging/pages", run_id=run_id)
        made = self.rechunk(run_id, now) if chunk else 0
        counts = seen.get
        if counts["without_pages"]:
            raise GateError(f"{counts['without_pages']} ok documents have no n_pages")
        quarantined = lake.read("silver/quarantine").where(F.col("run_id") == run_id).count()
        return {"documents_ok": counts["ok"], "duplicates": counts["duplicate"], "quarantined": quarantined, "chunks": made}

    def _existing(self) -> DataFrame:
        return self.lake.read("silver/documents", "record_key", "text_hash", "status")

    def rechunk(self, run_id: str, now: str, chunking: Chunking | None = None) -> int:
        """Chunks in the given (else the current) version for ok documents that have none; other versions stay."""
        config, lake = chunking or self.chunking, self.lake
        docs = silver.missing_in_version(lake.read("silver/documents"), lake.read("silver/chunks", "doc_id", "chunk_config_version"), config.version)
        stored = lake.read("silver/pages").join(docs.select("doc_id"), "doc_id", "left_semi")
        read = stored.withColumn("headings", F.from_json("headings_json", "array<struct<line:int,heading:string>>")).withColumn("tables", F.from_json("tables_json", "array<string>"))
        meta = docs.select("doc_id", "source", "source_id", "docket", "title", "published_at", "url")
        cut = chunk_pages(read, config).join(meta, "doc_id")
        context = context_header(F.col("title"), F.col("docket"), F.col("section")) if config.prepend_context else F.lit("")
        named = cut.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_config_version"), F.col("ordinal"))).withColumn("context", context)
        rows = self._fit(named.withColumn("run_id", F.lit(run_id)).withColumn("chunked_at", F.lit(now)), "silver/chunks")
        lake.merge("silver/chunks", rows, ["chunk_config_version", "chunk_id"])
        return lake.chunks_of(config.version).where(F.col("chunked_at") == now).count()

    # the SQL gate
    def gate(self) -> list[str]:
        """Stops the run if a rule of the silver tables is broken; returns what is only worth a warning."""
        lake, g = self.lake, self.settings["gate"]
        docs, chunks = lake.read("silver/documents"), lake.chunks_of(self.chunking.version)
        keys = lake.read("bronze/manifest").select(F.concat_ws(":", "source", "source_id").alias("record_key"))
        # one job; a row for each rule
        broken = [r["rule"] for r in quality.suite(docs, chunks, keys, g["max_chunk_tokens"]).collect() if r["broken"]]
        if broken:
            raise GateError("; ".join(broken))
        full = self.health().where(F.col("quarantine_rate") > g["max_quarantine_rate"]).select("run_id", "quarantine_rate").collect()  # a row for each run
        return [f"{r['quarantine_rate']:.0%} of {r['run_id']} are in quarantine" for r in sorted(full)]

    def health(self) -> DataFrame:
        key = F.concat_ws(":", "source", "source_id").alias("record_key")
        return marts.pipeline_health(self.lake.read("bronze/manifest").select("*", key), self.lake.read("silver/documents"), self.lake.read("silver/quarantine"))

    # gold
    def gold(self, run_id: str, now: str, model: str = "hash-64", embed: Callable[[Column], Column] | BatchModel = retrieval.hash_embedding) -> int:
        """Embed and index the chunks that the version lacks; then the version is active. Returns how many were new.

        Texts that the model has embedded before, for whatever version, are taken from the cache.
        """
        lake = self.lake
        name = index_version(F.lit(self.chunking.version), F.lit(model))
        rows = lake.chunks_of(self.chunking.version).withColumn("index_version", name)
        have = lake.read("gold/chunks", "index_version", "chunk_id")
        read = F.concat_ws("\n", F.nullif("context", F.lit("")), "text")
        fresh = rows.join(have, ["index_version", "chunk_id"], "left_anti").withColumn("embedded", read).withColumn("text_hash", F.sha2("embedded", 256))
        missing = retrieval.cache_misses(fresh.select("text_hash", F.col("embedded").alias("text")), lake.read("gold/embeddings"), model)
        new = embedded(missing, embed, "text").select(F.lit(model).alias("model"), "text_hash", "embedding", F.lit(run_id).alias("run_id"))
        lake.merge("gold/embeddings", self._fit(new, "gold/embeddings"), ["model", "text_hash"])
        vectors = lake.read("gold/embeddings").where(F.col("model") == model).select("text_hash", "embedding")
        indexed = fresh.join(vectors, "text_hash").withColumn("run_id", F.lit(run_id))
        lake.merge("gold/chunks", self._fit(indexed, "gold/chunks"), ["index_version", "chunk_id"])
        version = self.lake.spark.range(1).select(name.alias("v")).first()["v"]
        # what a run before has left out is taken in, too: the index knows its chunks
        self.text_index(version).add(self._lexical(lake.read("gold/chunks").where(F.col("index_version") == version)), run_id)
        n = lake.read("gold/chunks").where((F.col("index_version") == version) & (F.col("run_id") == run_id)).count()
        self.activate(version, now, model)
        return n

    @staticmethod
    def _lexical(chunks: DataFrame) -> DataFrame:
        return chunks.withColumn("lexical", F.concat_ws(" ", "context", "text"))

    def text_index(self, version: str) -> TextIndex:
        """The inverted index of an index version; it grows by a segment for each run."""
        return TextIndex(self.lake.spark, self.lake.path(f"gold/terms/{version}"))

    def versions(self) -> DataFrame:
        """The latest state of each version; states are appended, so activation rewrites nothing."""
        return silver.latest(self.lake.read("gold/versions"), ["index_version"], [F.desc("run_id")]).orderBy("created_at", "index_version")

    def activate(self, version: str, now: str, model: str | None = None) -> None:
        """Exactly one version is active afterwards. The registry has a row per version and is handled on the driver."""
        known = {r["index_version"]: r.asDict() for r in self.versions().collect()}
        if model is None and version not in known:
            raise ValueError(f"unknown index version {version}")
        chunks = self.lake.read("gold/chunks").where(F.col("index_version") == version).count()
        known.setdefault(version, {"chunk_config_version": self.chunking.version, "model": model, "created_at": now})
        known[version] |= {"index_version": version, "activated_at": now, "n_chunks": chunks}
        schema = lakes.SCHEMAS["gold/versions"]
        rows = [tuple({**r, "is_active": v == version, "run_id": now}.get(f.name) for f in schema) for v, r in known.items()]
        self.lake.append("gold/versions", self.lake.spark.createDataFrame(rows, schema))

    def active(self) -> str:
        found = self.versions().where("is_active").select("index_version").first()
        if found is None:
            raise ValueError("no index version is active")
        return found["index_version"]

    def search(self, questions: DataFrame, embed: Callable[[Column], Column] | BatchModel = retrieval.hash_embedding, mode: str = "rerank", score: Callable[[DataFrame], Column] | BatchModel = retrieval.overlap_score, **filters) -> DataFrame:
        """questions: query_id, qtext. Hits of the active version with their neighbours.

        ``dense`` ranks by vectors alone, ``hybrid`` fuses them with the codes of a question, ``rerank`` takes candidates from vectors and
        rare terms and ranks them by ``score``.
        """
        if mode not in MODES:
            raise ValueError(f"mode must be one of {sorted(MODES)}, not {mode!r}")
        s = self.settings["search"]
        version = self.active()
        pool = retrieval.filtered(self.lake.read("gold/chunks").where(F.col("index_version") == version), **filters)
        asked = embedded(questions, embed, "qtext", "qvec")
        # the terms come from the index of the version; what is rare is a matter of all its chunks, filtered or not
        terms = self.text_index(version)
        part = pool.select("chunk_id") if any(filters.values()) else None
        n = terms.size() if MODES[mode] == "rare" else None
        found = retrieval.search(pool.select("chunk_id", "embedding"), asked, s["candidates"] if mode == "rerank" else s["k"], MODES[mode], n, index=terms, part=part)
        hits = retrieval.materialize_hits(found, pool.drop("embedding"))
        if mode == "rerank":
            # as for any hit, the score shown is the last one
            hits = retrieval.rerank(hits.join(questions, "query_id"), score, s["k"]).drop("score", "qtext", "first_rank").withColumnRenamed("rescored", "score")
        # read for the hits and for their places
        hits = materialize(hits, "hits")
        wide = lambda df: df.withColumns({c: F.col(c).cast("long") for c in ("page_start", "page_end", "ordinal")})
        places = wide(hits).dropDuplicates(["doc_id", "ordinal"]).drop("query_id", "rank", "score")
        expanded = retrieval.expand(places, wide(pool.drop("embedding")), s["window"])
        return hits.select("query_id", "rank", "score", "chunk_id").join(expanded, "chunk_id").join(questions, "query_id")

    def answer(self, questions: DataFrame, now: str | None = None, mode: str = "rerank", generate: Callable[[DataFrame], DataFrame] | None = None, model: str = "extractive", use_cache: bool = True, **filters) -> DataFrame:
        """query_id, answer, cited, cache (hit or miss).

        ``generate`` makes query_id, answer, cited and, if it may fall back on something poorer, degraded, from query_id, qtext, n, context_text; without it
        the answer is extracted. Answers are kept for a time under a key of the question and all that can change them; degraded
        ones are not kept.
        """
        now = now or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        s = self.settings["search"]
        scope = {"v": self.active(), "m": model, "k": str(s["k"]), "f": json.dumps({k: v for k, v in filters.items() if v}, sort_keys=True), "r": mode, "x": str(s["window"]), "c": str(s["candidates"])}
        keyed = questions.withColumn("key", cache_key(F.col("qtext"), **{k: F.lit(v) for k, v in scope.items()}))
        age = F.unix_timestamp(F.lit(now), "yyyy-MM-dd'T'HH:mm:ss'Z'") - F.unix_timestamp("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        # a few questions look into a few buckets of the answers
        touched = [r["b"] for r in keyed.select(lakes.bucket_of(F.col("key")).alias("b")).distinct().collect()]
        valid = self.lake.in_buckets("gold/answers", touched).where(age.between(0, self.settings["answers"]["ttl_seconds"]))
        known = valid.groupBy("key").agg(F.max_by(F.struct("answer", "cited"), "created_at").alias("a"))
        hits = keyed.join(known, "key").select("query_id", "a.answer", "a.cited", F.lit("hit").alias("cache"))
        missing = materialize(keyed.join(known, "key", "left_anti") if use_cache else keyed, "asked")
        if missing.isEmpty():
            return hits
        found = self.search(missing.drop("key"), mode=mode, **filters).select("query_id", "qtext", F.col("rank").alias("n"), "context_text")
        made = (generate or retrieval.extractive_answer)(found)
        made = materialize(made if "degraded" in made.columns else made.withColumn("degraded", F.lit(False)), "answers")
        if use_cache:
            kept = made.where("NOT degraded").join(missing.select("query_id", "key"), "query_id").dropDuplicates(["key"])
            rows = kept.withColumn("created_at", F.lit(now)).withColumn("run_id", F.lit(now))
            self.lake.merge("gold/answers", self._fit(rows, "gold/answers"), ["key", "created_at"])
        fresh = made.select("query_id", "answer", "cited", F.lit("miss").alias("cache"))
        return hits.unionByName(fresh) if use_cache else fresh

    # views for whoever runs the lake
    def status(self) -> dict:
        """Counts of each table, the active version, high-water marks and the last report."""
        docs = {r["status"]: r["count"] for r in self.lake.read("silver/documents", "status").groupBy("status").count().collect()}
        known = self.versions().where("is_active").select("index_version").first()
        return {
            "active_index": known and known["index_version"],
            "chunk_config_version": self.chunking.version,
            "bronze_records": self.lake.read("bronze/manifest", "source_id").count(),
            "documents_ok": docs.get("ok", 0),
            "duplicates": docs.get("duplicate", 0),
            "quarantined": self.lake.read("silver/quarantine", "record_key").count(),
            "chunks": self.lake.chunks_of(self.chunking.version).select("chunk_id").distinct().count(),
            "watermarks": {r["source"]: r["high_water"] for r in self.watermark().collect()},
            "latest_validation": next((r.asDict() for r in lakes.latest_report(self.lake.read("bronze/reports")).collect() if r["run_id"]), None),
        }

    def quarantine(self) -> DataFrame:
        """Records in quarantine with their titles, the newest first."""
        named = self.lake.read("bronze/manifest", "source", "source_id", "title", "url")
        rows = self.lake.read("silver/quarantine").join(named, ["source", "source_id"], "left")
        return rows.select("source_id", "stage", "reason", "quarantined_at", "title", "url").orderBy(F.desc("quarantined_at"), "source_id")

    def documents(self, contains: str = "", most: int = 100) -> DataFrame:
        return marts.document_search(self.lake.read("silver/documents"), contains, most)

    def evaluate(self, golden: DataFrame, mode: str = "rerank", name: str = "dev", now: str | None = None, generate: Callable[[DataFrame], DataFrame] | None = None, judge: BatchModel | None = None) -> dict:
        """golden: id, question, expected_source_ids, answer_contains. The report is written as JSON and as Markdown below eval/.

        Questions are asked one after another, after a first one that warms up, and each is timed: a golden set is written by hand. One
        that fails is an error of its own and counts for nothing else; after three failures in a row the rest is left.
        ``generate`` as for ``answer``; it may also give read_tokens, written_tokens and input_tokens. ``judge`` grades answers beside the exact match.
        """
        spark, asked = self.lake.spark, [(r["id"], r["question"]) for r in golden.orderBy("id").select("id", "question").collect()]
        one = lambda i, text: spark.createDataFrame([(i, text)], "query_id long, qtext string")
        found, said, lines, failures = [], [], [], 0
        for i, (key, text) in enumerate([*asked[:1], *asked]):
            row = {"question_id": key, "error": None, "retrieval_ms": None, "total_ms": None, "read_tokens": None, "written_tokens": None, "input_tokens": None}
            begin = time.monotonic()
            try:
                hits = self.search(one(i, text), mode=mode).collect()  # k rows
                row["retrieval_ms"] = (time.monotonic() - begin) * 1000
                docs = spark.createDataFrame([(i, text, h["rank"], h["context_text"]) for h in hits], "query_id long, qtext string, n int, context_text string")
                told = [r.asDict() for r in (generate or retrieval.extractive_answer)(docs).collect()]
                row["total_ms"] = (time.monotonic() - begin) * 1000
                if any(t.get("degraded") for t in told):
                    raise RuntimeError("the answer is a fallback")
                failures = 0
            except Exception as e:
                hits, told, failures = [], [], failures + 1
                row["error"] = repr(e)[:300]
            if not i:  # the warm-up
                failures = 0
                continue
            for t in told:
                row |= {k: t.get(k) for k in ("read_tokens", "written_tokens", "input_tokens")}
                said.append((key, t["answer"], t["cited"]))
            found += [(key, h["rank"], h["source_id"], h["context_text"]) for h in hits]
            lines.append(row)
            if failures == 3:
                break
        timed = spark.createDataFrame([tuple(r.values()) for r in lines], "question_id string, error string, retrieval_ms double, total_ms double, read_tokens long, written_tokens long, input_tokens long")
        results = spark.createDataFrame(found, "question_id string, rank int, source_id string, context string")
        answers = spark.createDataFrame(said, "question_id string, answer string, cited array<int>")
        rows = materialize(self._graded(golden, timed, results, answers, judge), "eval-rows")
        summary = {"set": name, "mode": mode, "index_version": self.active(), **evaluation.report(rows, self.settings["search"]["k"]).first().asDict()}
        shown = [r.asDict() for r in rows.orderBy("question_id").collect()]
        if all(r["error"] for r in shown) and shown:
            raise RuntimeError(f"every question failed; first error: {shown[0]['error']}")
        stamp = (now or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")).replace(":", "").replace("-", "")
        self.lake.write_text(json.dumps({"summary": summary, "rows": shown}, indent=2, default=str), f"eval/{stamp}_{mode}_{name}.json")
        self.lake.write_text(evaluation.to_markdown(summary, shown, f"{mode} on {name}"), f"eval/latest_{mode}_{name}.md")
        return summary

    @staticmethod
    def _graded(golden: DataFrame, timed: DataFrame, results: DataFrame, answers: DataFrame, judge: BatchModel | None) -> DataFrame:
        """A row for each question that was asked: ranks, whether the answer holds a phrase and cites an expected source, and the judge's verdict."""
        questions = golden.select(F.col("id").alias("question_id"), "question", "expected_source_ids", "answer_contains")
        expected = questions.select("question_id", F.explode("expected_source_ids").alias("source_id"))
        needles = questions.select("question_id", F.explode("answer_contains").alias("needle"))
        ranks = evaluation.first_ranks(results, expected).join(evaluation.needle_ranks(results, needles), "question_id", "full")
        said = answers.select("question_id", F.lit(1).alias("rank"), F.col("answer").alias("context"))
        right = evaluation.needle_ranks(said, needles).select("question_id", F.col("answer_rank").isNotNull().alias("answer_right"))
        cited = answers.select("question_id", F.explode("cited").alias("rank")).join(results, ["question_id", "rank"]).join(expected, ["question_id", "source_id"], "left_semi").select("question_id", F.lit(True).alias("cited_expected")).distinct()
        rows = timed.join(questions.select("question_id", "question"), "question_id").join(ranks, "question_id", "left").join(right, "question_id", "left").join(cited, "question_id", "left").withColumn("cited_expected", F.coalesce("cited_expected", F.lit(False)))
        if judge is None:
            return rows
        asked = questions.select("question_id", "question", F.array_join("answer_contains", "\n").alias("reference")).join(answers.select("question_id", "answer"), "question_id")
        return rows.join(judged(asked, judge).select("question_id", "judge_correct", "judge_reason"), "question_id", "left")

    def run(self, listed: DataFrame, run_id: str, now: str, checked: bool = True, retries: int = 2) -> dict:
        """All steps, each after the ones that it needs; a failed batch or a broken rule stops before the index is touched. A step that fails otherwise is tried again.

        Steps are kept in the run's journal: the same run, started again with the same settings, goes on at the step that did not end.
        """
        journal = Journal(self.lake, run_id, {"settings": self.settings, "chunking": self.chunking.version, "checked": checked})
        bronze = journal.step("bronze", lambda: attempt(lambda: self.ingest(listed, run_id, now), retries))
        if bronze["status"] == "failed":
            raise GateError("the batch failed validation")
        made = journal.step("silver", lambda: attempt(lambda: self.silver(run_id, now, chunk=False), retries))
        made = {**made, "chunks": journal.step("chunks", lambda: attempt(lambda: self.rechunk(run_id, now), retries))}
        warnings = journal.step("gate", self.gate) if checked else []
        return {"bronze": bronze, "silver": made, "warnings": warnings, "indexed": journal.step("gold", lambda: attempt(lambda: self.gold(run_id, now), retries))}

    def watch(self, poll: Callable[[], DataFrame | None], every: float = 900.0, once: bool = False, stop: threading.Event | None = None) -> int:
        """Take in what ``poll`` lists, again and again, until SIGTERM or ``stop``; returns the number of polls.

        A poll that fails is left to the next one: every step may be done again. The rules of the silver tables are left to the daily run.
        """
        stop = stop or threading.Event()
        main, before = threading.current_thread() is threading.main_thread(), None
        if main:
            before = signal.signal(signal.SIGTERM, lambda *_: stop.set())
        try:
            return self._polls(poll, every, once, stop)
        finally:
            if main:
                signal.signal(signal.SIGTERM, before)

    def _polls(self, poll: Callable[[], DataFrame | None], every: float, once: bool, stop: threading.Event) -> int:
        polls = 0
        while not stop.is_set():
            begin, polls = time.monotonic(), polls + 1
            now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
            try:
                listed = poll()
                if listed is not None:
                    made = self.run(listed, f"watch-{now}-{polls}", now, checked=False, retries=0)
                    log.info("%d new records", made["bronze"]["landed"])
            except Exception:
                log.exception("the poll failed; the next one tries again")
            if once:
                break
            stop.wait(max(MIN_WAIT, every - (time.monotonic() - begin)))
        return polls


MIN_WAIT = 5.0


class Journal:
    """The steps of a run that have ended, with their results, below ``state/journal``. A step's fingerprint is that of the settings and of the results of all steps before it."""

    def __init__(self, lake: lakes.Lake, run_id: str, settings: dict) -> None:
        self.lake, self.place = lake, f"state/journal/{quote(run_id, safe='')}"
        self.mark = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()

    def step(self, name: str, work: Callable[[], object]):
        kept = self.lake.read_text(f"{self.place}/{name}.json")
        entry = json.loads(kept) if kept else None
        if entry is None or entry["needs"] != self.mark:
            entry = {"needs": self.mark, "result": work()}
            # a step that refuses the batch is done again
            if not (isinstance(entry["result"], dict) and entry["result"].get("status") == "failed"):
                self.lake.write_text(json.dumps(entry), f"{self.place}/{name}.json")
        else:
            log.info("%s has been done before", name)
        self.mark = hashlib.sha256(f"{self.mark}{name}{json.dumps(entry['result'], sort_keys=True)}".encode()).hexdigest()
        return entry["result"]


def attempt(step: Callable[[], dict | int], retries: int):
    """Run a step, and again if it fails for another reason than a gate."""
    for left in range(retries, -1, -1):
        try:
            return step()
        except GateError:
            raise
        except Exception:
            if not left:
                raise
            log.exception("a step failed; %d tries left", left)
