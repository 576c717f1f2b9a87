"""Repeated rows and ids, clashing columns, hostile rows and empty tables in the operators and their registered queries."""

import struct
import subprocess
import sys

import duckdb
import numpy as np
import public_tokenizers
import pytest

from docstrata.llm import embeddings, licences, packing, queries, simhash, storage
from docstrata.llm.components import whole_cells
from docstrata.llm.language import has_letter, identify_languages
from docstrata.llm.media import box, media_columns, read_container, write_container
from docstrata.llm.pii import pii_report
from docstrata.llm.suffixes import remove_repeats
from tests.llm.test_near_duplicates import vectors

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_those_of_the_plain_tokenizer():
    from tokenizers import Tokenizer

    plain, enc, r = Tokenizer.from_file(PATH), packing.Encoder(PATH, memo=500), np.random.default_rng(0)
    bits = ["<|endoftext|>", "<|endoftext|", "word", " ", " ", "  ", "\n", "x.", "é", "12", "'s", "<|", "|>", "😀", "endoftext"]
    texts = ["x <|endoftext|> y", "<|endoftext|>", *("".join(r.choice(bits, r.integers(0, 10))) for _ in range(20_000))]
    assert sum("<|endoftext|>" in t for t in texts) > 1000
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_letters():
    assert [has_letter(t) for t in ("²", "½ Ⅷ ① 12 _", "²a", "漢", "ª", "12 é", "")] == [False, False, True, True, True, True, False]


def test_languages_of_repeated_ids(spark):
    words = {"xx": "the of and with", "yy": "der die und ung"}
    rows = [(i % 3, words[lang] * (1 + i % 5), lang) for i in range(400) for lang in words] + [(7, "½ ②", "xx"), (7, "½ ②", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'w' AS kept_text", "2.5 AS n")
    got = identify_languages(docs, keep=("text", "n")).collect()
    assert len(got) == len(rows) and all(r.lang_pred == next(k for k, v in words.items() if r.kept_text.startswith(v)) and r.kept_n == 2.5 for r in got if r.doc_id != 7)
    assert [(r.lang_pred, r.score) for r in got if r.doc_id == 7] == [("und", 0.0)] * 2
    again = identify_languages(docs, keep=("text", "n")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_boxes_that_nest_for_ever(spark):
    deep = b""
    for _ in range(1500):
        deep = box(b"moov", deep)
    good = write_container(b"a" * 192)
    files = [deep, good[:60] + deep, struct.pack(">I4s", 8, b"moov") * 50_000, b"\0" * 9]
    for data in files[:1]:
        with pytest.raises(ValueError):
            read_container(data)
    got = sorted(media_columns(spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(files)], "k int, media binary")).collect())
    assert all(r.track.error and r.track.codec is None for r in got)


def test_simhash_of_repeated_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (5, "quite another text here"), (2, "quite another text here"), (None, "z z z"), (9, None), (8, "")]
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    print_of = lambda t: f"{simhash.fingerprint(t):016x}"
    want = [(5, print_of("a b c d"), 5)] * 2 + [(5, print_of(rows[2][1]), 2), (2, print_of(rows[2][1]), 2), (-1, print_of("z z z"), None), (9, "0" * 16, 8), (8, "0" * 16, 8)]
    assert got == sorted(want, key=lambda x: x[:2])


@pytest.mark.parametrize("tile", [1, 3, 64])
def test_tiles_of_many_cells(tile):
    r = np.random.default_rng(tile)
    base = r.integers(0, 1 << 62, 30, dtype=np.uint64)
    flips = np.uint64(1) << r.integers(0, 64, (2, 400), dtype=np.uint64)
    prints = base[r.integers(0, 30, 400)] ^ flips[0] ^ flips[1]
    cell, part, across = r.integers(0, 12, 400), r.integers(0, 3, 400), r.random(12) < 0.4
    us, vs = simhash._tile_links(prints, part, across[cell], 3, tile=tile, cell=cell, most=5)
    got = {tuple(sorted(x)) for x in zip(np.concatenate(us).tolist(), np.concatenate(vs).tolist())}
    near = (np.bitwise_count(prints[:, None] ^ prints[None]) <= 3) & (cell[:, None] == cell[None]) & (~across[cell][:, None] | (part[:, None] != part[None]))
    assert got == {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near))) if i < j} and got


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_whole_cells(rows):
    import pyarrow as pa

    key = np.sort(np.random.default_rng(0).integers(0, 40, 500))
    table = pa.table({"k": key, "cell_a": key % 2 * 0, "cell_b": key * 0, "v": np.arange(500)})
    parts = list(whole_cells(iter(table.to_batches(max_chunksize=13)), ["k"], rows))
    assert pa.concat_tables(parts).equals(table) and (rows < 1000) == (len(parts) > 1)
    sets = [set(p["k"].to_pylist()) for p in parts]
    assert sum(map(len, sets)) == len(set().union(*sets))


def test_vectors_with_text_labels_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.01], "a"), (3, [1.0, 0.0], "b"), (2, [0.0, 1.0], "a"), (4, [0.01, 1.0], "a"), (5, [-1.0, 0.0], "a"), (1, [1.0, 0.0], "a")]
    got = sorted(tuple(r) for r in embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").selectExpr("*", "1 AS rep", "2 AS weight")).collect())
    # the two vectors of id 2 stand together
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True), (4, 1, 1, False), (5, 0, 5, True)]


def test_vectors_as_sql_has_them(spark, tmp_path):
    rows = [(i, v, label) for i, (v, label) in enumerate(vectors())]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("vec_id", "cast(embedding AS array<float>) AS embedding", "label").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(f"SELECT vec_id, n_links, component_id, kept FROM ({queries.oracle_sql()['op4_embedding_near_dedup']})").fetchall()
    got = [tuple(r) for r in queries.queries()["op4_embedding_near_dedup"](spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(got) == sorted(want) and sum(r[1] > 0 for r in want) > 50


def test_null_ids_come_first(spark):
    rows = [(None, [1.0, 2.0], 0), (4, [1.0, 2.0], 0), (4, [1.0, 2.0], 0), (5, [1.0, -2.0], 0)]
    got = embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 2, None, True), (4, 2, None, False), (4, 2, None, False), (5, 0, 5, True)], key=repr)
    t = "abcdefghij" * 8
    got = remove_repeats(spark.createDataFrame([(-5, t), (None, t), (1 << 60, t), ((1 << 60) + 1, "q")], "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_removed) for r in got], key=repr) == sorted([(None, 0), (-5, 80), (1 << 60, 80), ((1 << 60) + 1, 0)], key=repr)


def test_repeats_with_shared_ids(spark):
    t, u = "x" * 30 + "abcdefghij" * 6, "y" * 20 + "abcdefghij" * 6
    rows = [(1, t), (1, u), (1, t), (2, t), (3, None)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 80, 0, 0), (1, 90, 0, 0), (1, 90, 0, 0), (2, 90, 90, 1), (3, 0, 0, 0)]


def test_licences_and_spans_of_repeated_rows(spark):
    from docstrata.llm.licence_texts import KNOWN

    rows = [(1, KNOWN["MIT"]), (1, KNOWN["MIT"]), (1, "a@b.co " * 30_000)]
    found = licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.licence) for r in found) == ["MIT", "MIT", "None"]
    spans = sorted(r.n_email for r in pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert spans == [0, 0, 30_000]


SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
}
ROWS = {
    "documents": [(i, "the of and der die a@b.co " * (1 + i % 4), ["en", "de", None][i % 3], "s", 1) for i in range(40)] + [(41, None, None, None, None), (42, "", "en", "s", 0), (0, "the of", "en", "s", 6), (None, "the of and der die a@b.co " * 3, "de", "s", 1), (None, None, None, None, None)],
    "pages": [(1, "u", "<article>a</article>"), (2, None, None)],
    "embeddings": [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, None, None), (None, [1.0, 2.0], 0), (None, None, 0)],
    "conversations": [(1, 0, "user", "a b"), (1, 1, "user", None)],
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for kind in ("full", "empty"):
        out[kind] = tmp_path_factory.mktemp(kind)
        for name, schema in SCHEMAS.items():
            spark.createDataFrame(ROWS[name] if kind == "full" else [], schema).selectExpr("*", "7 AS block", "8 AS part", "9 AS cell").write.parquet(str(out[kind] / f"{name}.parquet"))
    return out


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_queries_keep_every_row(spark, folders, name):
    full = queries.queries()[name](spark, str(folders["full"])).collect()
    empty = queries.queries()[name](spark, str(folders["empty"]))
    table = {"op1": "pages", "op4": "embeddings", "op7": "conversations", "op12": "conversations"}.get(name.split("_")[0], "documents")
    if name.startswith("op12_"):
        # a row for each node: the one conversation is the smallest member of its root and of what is left of it
        assert {r.conv_id for r in full} == {1} and sum(r.depth == 0 for r in full) == 1 and empty.count() == 0
        return
    key = {"documents": "doc_id", "pages": "page_id", "embeddings": "vec_id", "conversations": "turn"}[table]
    rows = ROWS[table] if table != "conversations" else [(t,) for _, t, *_ in ROWS[table]]
    assert {r[key] for r in full} == {r[0] for r in rows} and empty.count() == 0
    if name.split("_")[0] not in ("op2", "op7"):
        assert sorted((r[key] for r in full), key=repr) == sorted((r[0] for r in rows), key=repr)


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Fake)


def test_intermediates_go(spark):
    from pathlib import Path

    with storage.intermediates():
        df = storage.materialize(spark.range(3).selectExpr("id"), "x")
        folder = Path(df.inputFiles()[0].removeprefix("file://")).parent
        assert folder.exists() and df.count() == 3
    assert not folder.exists()
    df = storage.materialize(spark.range(3).selectExpr("id"), "y")
    storage.release(df)
    assert not Path(df.inputFiles()[0].removeprefix("file://")).parent.exists()


def test_nothing_is_left_at_the_end(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
from docstrata.llm.storage import materialize
assert materialize(spark.range(5).selectExpr("id"), "z").count() == 5
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True)
    assert not list((tmp_path / "docstrata").iterdir())


def test_an_operator_makes_room_in_its_worker():
    from docstrata.llm.workers import make_room

    packing._encoders.clear()
    first = packing.encoder(PATH)
    assert packing.encoder(PATH) is first
    make_room("suffixes")
    assert not packing._encoders and packing.encoder(PATH) is not first
    assert packing.encoder(PATH).encode("a b") == first.encode("a b")
