"""SimHash and embedding groups, and packing, against brute force on small fixtures."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from docstrata.llm import embeddings, packing, simhash
from docstrata.llm.components import connected, local_roots


def roots(near):
    i, j = np.nonzero(near)
    return local_roots(len(near), i, j)


def texts(seed=3, n=150):
    r = random.Random(seed)
    base = [" ".join(r.choice("alpha beta Gamma delta é epsilon".split()) + str(r.randint(0, 40)) for _ in range(r.randint(1, 120))) for _ in range(n)]
    out = list(base)
    for t in base[:60]:
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        out += [" ".join(w), t.upper().lower() if r.random() < 0.3 else t]
    return [*out, None, "", "one", "one two", "  \t one\x0btwo ", "x " * 30_000]


@pytest.mark.parametrize("tile", [2048, 16])
def test_simhash_groups(spark, tile, monkeypatch):
    data = list(enumerate(texts()))
    links = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda prints, radius: links(prints, radius, tile=tile))
    got = sorted(simhash.simhash_groups(spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS print", "2 AS root")).collect())
    prints = np.array([simhash.fingerprint(t) for _, t in data], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 3
    assert [r.component_id for r in got] == roots(near).tolist() and [int(r.fingerprint, 16) for r in got] == prints.tolist()
    assert got[-6].fingerprint == got[-5].fingerprint == "0" * 16 and near.sum() > len(data) + 100


def test_dense_tile_links():
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 63, 1, dtype=np.uint64)
    prints = np.unique(base ^ (np.uint64(1) << r.integers(0, 64, 4000, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 4000, dtype=np.uint64)))
    us, vs = simhash._tile_links(prints, np.zeros(len(prints), int), False, 3)
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 3
    assert (local_roots(len(prints), np.concatenate(us), np.concatenate(vs)) == roots(near)).all()


def test_simhash_of_nothing(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_never_lose_a_pair():
    r = random.Random(1)
    masks = simhash.block_masks(3)
    for _ in range(2000):
        flips = sum(1 << b for b in r.sample(range(64), 3))
        assert any(not flips & m for m in masks)


def vectors(seed=5):
    r = np.random.default_rng(seed)
    base = r.normal(size=(150, 16))
    rows = [(b.tolist(), int(i % 3)) for i, b in enumerate(base)]
    for i in range(80):
        rows.append(((base[i] + r.normal(size=16) * r.choice([0.02, 0.15, 0.2])).tolist(), int(i % 3)))
    rows += [((base[0] * 3 + r.normal(size=16) * 0.05).tolist(), 0) for _ in range(60)] + [(base[1].tolist(), 1)] * 10
    return [*rows, (None, 0), ([0.0] * 16, 0), ([1.0, None] + [0.0] * 14, 0), ([float("nan")] * 16, 1), ([float("inf")] * 16, 1), (base[2].tolist(), None), ([1.0, 2.0], 0), ([2.0, 4.0], 0), ([], 0)]


@pytest.mark.parametrize("kind,per_cell,tile", [("float", 400, 1024), ("float", 10, 1024), ("double", 10, 8), ("double", 5, 16)])
def test_embedding_groups(spark, kind, per_cell, tile):
    rows = [(i, v, label) for i, (v, label) in enumerate(vectors())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("vec_id", f"cast(embedding AS array<{kind}>) AS embedding", "label", "1 AS cell", "2 AS home")
    got = sorted(embeddings.embedding_groups(df, per_cell=per_cell, tile=tile).collect())
    near = np.zeros((len(rows), len(rows)), bool)
    for i, a, la in rows:
        for j, b, lb in rows:
            ok = i != j and la == lb and la is not None and a and b and len(a) == len(b) and None not in a + b and np.isfinite(a + b).all() and any(a) and any(b)
            if ok:
                x, y = np.array(a, kind == "float" and np.float32 or float).astype(float), np.array(b, kind == "float" and np.float32 or float).astype(float)
                near[i, j] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98
    assert [r.n_links for r in got] == near.sum(axis=1).tolist()
    assert [r.component_id for r in got] == roots(near).tolist() and [r.kept for r in got] == [r.vec_id == r.component_id for r in got]


def test_embeddings_of_nothing(spark):
    assert embeddings.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 300)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (5, 3), (3, 5)]
    got = {r.vertex: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 301)) and all(got[i] == 1000 for i in range(1000, 1100)) and got[5] == got[3] == 3 and 7 not in got


PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_is_the_tokenizer():
    enc = packing.Encoder(PATH, memo=20)
    r = random.Random(2)
    bits = ["word", "don't", "é", ".", ",", "'s", " ", "  ", "\n", "\t", " ", "　", "12", "<|endoftext|>", "漢字", "x.", "a,b.", "...", "\x1c", "😀", "_", "naïve."]
    for _ in range(3000):
        t = "".join(r.choice(bits) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 12)))
        assert enc.encode(t) == enc.whole(t), repr(t)


def test_packing(spark):
    enc = packing.Encoder(PATH)
    data = [(i, " ".join(f"w{j}" for j in range((i * 37) % 900))) for i in range(60)] + [(100, None), (100, None), (101, ""), (102, "long " * 9000)]
    rows = packing.pack_documents(spark.createDataFrame(data, "doc_id long, text string").repartition(7).selectExpr("*", "1 AS part", "2 AS length"), PATH, length=256, open_windows=4, group_pieces=10).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 256
    for doc, text in {d: t for d, t in data}.items():
        ids, copies = enc.encode(text or "") + b"\0\0\0\0", sum(d == doc for d, _ in data)
        assert sum(p.length for p in by_doc[doc]) == copies * len(ids) // 4
        assert all(p.doc_tokens == len(ids) // 4 and p.ids_crc32 == zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) for p in by_doc[doc])
    assert sum(r.length for r in rows) / 256 / len(by_sequence) > 0.9
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_leftovers_fit_well():
    lengths = np.random.default_rng(0).integers(1, 1024, 2000)
    number, offset = packing.merge_leftovers(lengths, 1024)
    order = np.lexsort((offset, number))
    ends = offset + lengths
    same = number[order][1:] == number[order][:-1]
    assert (offset[order][1:][same] == ends[order][:-1][same]).all() and ends.max() <= 1024
    assert lengths.sum() / 1024 / (number.max() + 1) > 0.97
