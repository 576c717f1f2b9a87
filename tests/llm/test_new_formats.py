"""The token store, the conversation trie and fill-in-the-middle against plain versions."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from docstrata.llm import conversation_trie, fill_in_middle, token_store
from docstrata.llm.storage import scratch

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
EXTRA = ("*", "7 AS part", "8 AS start", "'x' AS ids", "9 AS family", "'y' AS output")


def plain_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids, 0]


def texts():
    r = np.random.default_rng(4)
    words = ["the", "of", "naïve", "x1", "über", "<|endoftext|>", "\n", "日本", ""]
    return [(i * 7 % 60, " ".join(r.choice(words, r.integers(0, 40)))) for i in range(60)] + [(60, None), (61, ""), (62, "long " * 40_000), (None, "no id"), (None, "no id"), (5, "again")]


def test_tokens_are_those_of_the_plain_tokenizer(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr(*EXTRA)
    got = sorted(token_store.token_report(docs, TOKENIZER).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()][:-1]
    want = defaultdict(list)
    for d, t in rows:
        ids = plain_ids(t)
        want[d].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for d, found in want.items():
        assert sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == d) == sorted(found)


def test_blocks_of_texts_hand_each_core_of_a_word_over_once(monkeypatch):
    from docstrata.llm.packing import Encoder, _bytes

    enc, handed = Encoder(TOKENIZER), []
    fresh = enc._fresh
    monkeypatch.setattr(enc, "_fresh", lambda words, lead=" ": [handed.extend(lead + w for w in words), fresh(words, lead)][1])
    block = ["a core, core. core", "b core\ncore, x", "c core.\ncore.\ncore", "d core,", ""]
    ids, at = enc.encode_all(block, _bytes([0]))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain_ids(t) for t in block]
    assert sorted(handed) == ["\ncore", " core", " x"]


@pytest.mark.parametrize("memo", [3, 500_000])
def test_blocks_of_texts_have_the_ids_of_the_plain_tokenizer(memo):
    from docstrata.llm.packing import Encoder, _bytes

    r = np.random.default_rng(11)
    parts = ["a", "Ab", "é", "日本", "7", "²", "x1", ".", ",", "..", '"', "'s", "\n", "\n\n", "\t", " ", " ", " ", " ", " ", "  ", "\r\n", "\x1c", "\x85", "\u00a0", "\u0301", "\0", "ж", "<|endoftext|>", "🙂", "ª", "_"]
    enc = Encoder(TOKENIZER, memo)
    blocks = [["".join(r.choice(parts, r.integers(0, 12))) for _ in range(1500)] for _ in range(3)] + [["", "", ""], ["a\n"], ["\na"], [" a ", " ."], ["a, \tb", "a,", "a.", "a\n.", "a \tb"]]
    for block in blocks:
        ids, at = enc.encode_all(block, _bytes([0]))
        assert len(at) == len(block) + 1 and at[0] == 0 and at[-1] == len(ids)
        for k, text in enumerate(block):
            assert ids[at[k] : at[k + 1]].tobytes() == enc.whole(text) + _bytes([0]), repr(text)
            assert enc.encode(text) == enc.whole(text), repr(text)


def test_a_block_is_cut_into_batches_of_few_tokens(spark, monkeypatch):
    monkeypatch.setattr(token_store, "BATCH_TOKENS", 100)
    monkeypatch.setattr(token_store, "BLOCK_TEXTS", 7)
    test_tokens_are_those_of_the_plain_tokenizer(spark)


def test_store_prunes_and_reads_single_documents(spark):
    path = scratch(spark, "store")
    docs = spark.createDataFrame([(i, f"document number {i}") for i in range(3000)], "doc_id long, text string").repartition(3)
    token_store.write_tokens(docs, path, TOKENIZER, index_rows=1000)
    parts = token_store.parts(spark, path).orderBy("part").collect()
    assert sum(p.n_docs for p in parts) == 3000 and all(a.last_id < b.first_id and a.start + a.n_tokens == b.start for a, b in zip(parts, parts[1:]))
    found = token_store.read_tokens(spark, path, only=[2999, 17, 5000])
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PushedFilters: \[.*In\(doc_id, \[", plan)
    assert sorted((r.doc_id, r.ids) for r in found.collect()) == [(17, plain_ids("document number 17")), (2999, plain_ids("document number 2999"))]
    import pyarrow.orc as orc

    part = next(__import__("pathlib").Path(path.removeprefix("file://")).glob("ids/*.orc"))
    assert orc.ORCFile(part).row_index_stride == 1000 and orc.ORCFile(part).compression == "ZSTD"


def test_one_id_of_most_rows_is_spread(spark):
    path = scratch(spark, "hot")
    docs = spark.createDataFrame([(1 if i % 3 else i, f"text {i}") for i in range(4000)], "doc_id long, text string").repartition(4)
    token_store.write_tokens(docs, path, TOKENIZER)
    assert token_store.parts(spark, path).where("first_id = 1 AND last_id = 1").count() > 1


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = [*turns.get(base, [])[:h], *turns[c][h:]]
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own_members in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own_members) - 1) * len(node[-1][1].encode()) if node else 0
    digest = lambda node: hashlib.sha256(",".join(str(c) for c in sorted(members[node]) if len(rebuilt[c]) == len(node)).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], digest(n)) for n, m in members.items())


def talks():
    r = np.random.default_rng(9)
    rows = []
    for conv in [*range(60), 90, 91, 93, -3, -7, 1002]:
        for turn in range(int(r.integers(1, 25 if conv % 7 == 0 else 10))):
            # few texts, so that paths are shared beyond families
            rows.append((conv, None if turn == 0 and conv % 4 == 0 else turn, ["user", "assistant", None][int(r.integers(0, 3))] if conv % 3 == 0 else "user", ["é" * (turn % 3), None, "same"][int(r.integers(0, 3))] if conv % 2 else "same"))
    rows += [(200 + i, 0, "user", "hello") for i in range(40)] + [(7, 3, "user", "same"), (7, 3, "user", "same"), (None, 1, "user", "lost"), (5, 9, "a", "b" * 100_000)]
    return rows


@pytest.mark.parametrize("long_turns", [1024, 12, 3, 0])
def test_trie_is_the_plain_one(spark, long_turns):
    rows = talks()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).selectExpr(*EXTRA, "1 AS conv", "2 AS depth")
    got = [tuple(r) for r in conversation_trie.conversation_trie(turns, long_turns=long_turns).collect()]
    assert sorted(got, key=repr) == sorted(plain_trie(rows), key=repr)


def test_trie_as_sql_has_it(spark):
    rows = talks()
    schema = "conv_id long, turn long, role string, text string"
    con = duckdb.connect()
    frame = spark.createDataFrame(rows, schema).toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    con.sql("CREATE TABLE conversations AS SELECT * FROM frame")
    assert sorted(con.sql(conversation_trie.oracle()).fetchall(), key=repr) == sorted(plain_trie(rows), key=repr)


def test_hashes_of_a_shared_end_are_joined_in_parts(spark):
    ends = spark.range(5000).selectExpr("1L AS depth", "2L AS k1", "3L AS k2", "id AS conv").union(spark.sql("SELECT 1L, 2L, 4L, 77L"))
    got = {r.k2: r.ends_sha256 for r in conversation_trie.ends_digests(ends, most=100).collect()}
    assert got == {3: hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest(), 4: hashlib.sha256(b"77").hexdigest()}


def test_fill_in_middle_is_the_plain_one(spark):
    rows = [(i, t) for i, t in enumerate(["", None, "a", "é日\n<p>", "x<P>y", "<S>", "a<M>", "<P", "S><", "𝒳y" * 9] + ["w" * n + "<" + "ü" for n in range(200)])] + [(None, "no id"), (3, "abc")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(*EXTRA)
    got = sorted((tuple(r) for r in fill_in_middle.fill_in_middle_report(docs).collect()), key=repr)
    want = []
    for d, t in rows:
        t = t or ""
        h = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        plain = not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90
        form = "plain" if plain else "spm" if h4 % 100 < 20 else "psm"
        out = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((d, len(t), form, None if plain else a, None if plain else b - a, sha(out), sha(t)))
    assert got == sorted(want, key=repr) and {r[2] for r in got} == {"plain", "psm", "spm"}


def test_units_of_words(spark):
    docs = spark.createDataFrame([(i, "one two  three\nfour ") for i in range(30)], "doc_id long, text string")
    got = fill_in_middle.fill_in_middle(docs, units=r"\S+\s*").withColumn("back", fill_in_middle.restored(fill_in_middle.F.col("output"), fill_in_middle.F.col("form"))).collect()
    assert {r.n for r in got} == {4} and all(r.back == "one two  three\nfour " for r in got)
    assert {r.prefix_chars for r in got} <= {None, 0, 4, 9, 15, 20}
    with pytest.raises(ValueError):
        fill_in_middle.fill_in_middle(docs, markers=("<P>", "<P>", "<M>"))
