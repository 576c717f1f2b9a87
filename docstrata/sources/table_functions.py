"""Table functions for ad-hoc SQL: parsing and chunking as ``SELECT * FROM f(TABLE(...) PARTITION BY ...)``.

Spark deals a table argument by its partition columns and sorts it; a function's object sees one partition's rows in order, so a
document is packed as its pages come, and what is held is that document.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row

from docstrata.operators.chunking import CHUNKS, Chunking, Packer, tokenizer
from docstrata.operators.pages import ParseError, parse_document

PAGES = "key string, page_no int, text string, tables array<string>, n_pages_total int, error string"


def chunk_function(config: Chunking | None = None):
    """``chunk_pages(TABLE(pages) PARTITION BY doc_id ORDER BY page_no)``: pages have doc_id, page_no, text, and if they like headings (line, heading) and tables."""
    config = config or Chunking()
    version = config.version

    class ChunkPages:
        def __init__(self) -> None:
            self.packer, self.doc = Packer(config, tokenizer(config.tokenizer)), None

        def eval(self, page: Row):
            self.doc = page["doc_id"]
            have = page.asDict()
            headings = {h["line"]: h["heading"] for h in have.get("headings") or []}
            self.packer.page(page["page_no"], page["text"] or "", headings, have.get("tables") or [])

        def terminate(self):
            for c in self.packer.finish():
                yield str(self.doc), version, c["ordinal"], c["chunk_type"], c["section"], c["page_start"], c["page_end"], c["n_tokens"], c["text"]

    return udtf(ChunkPages, returnType=CHUNKS)


def parse_function(most_pages: int = 400):
    """``parse_files(TABLE(files))``: files have key, content (text or bytes) and extension; a row for each page, or one with an error."""

    class ParseFiles:
        def eval(self, file: Row):
            content = file["content"]
            try:
                found = parse_document(content.encode() if isinstance(content, str) else bytes(content or b""), file["extension"], most_pages)
            except ParseError as e:
                yield str(file["key"]), None, None, None, None, str(e)[:1000]
                return
            for i, text in enumerate(found.texts, 1):
                yield str(file["key"]), i, text, found.tables[i - 1] if found.tables else [], found.total, None

    return udtf(ParseFiles, returnType=PAGES)


def register(spark: SparkSession, config: Chunking | None = None, most_pages: int = 400) -> None:
    """The functions under their names in the session's SQL."""
    spark.udtf.register("chunk_pages", chunk_function(config))
    spark.udtf.register("parse_files", parse_function(most_pages))
