"""Near-duplicates by similarity: fingerprints, links and keepers against plain versions, recall against exact Jaccard similarity."""

import random

import numpy as np
import pytest

from docstrata.llm import simhash_similar as similar
from docstrata.llm.components import local_roots

SCHEMA = "doc_id long, text string"


def sets(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts(seed=5, n=80, copies=(0.004, 0.02, 0.05)):
    r = random.Random(seed)
    word = lambda: r.choice("alpha beta Gamma delta é epsilon".split()) + str(r.randint(0, 400))
    base = [" ".join(word() for _ in range(r.randint(60, 600))) for _ in range(n)]
    out = list(base)
    for t in base[: n // 2]:
        for share in copies:
            out.append(" ".join(word() if r.random() < share else w for w in t.split()))
    return [*out, base[0].upper().lower(), base[1] + " more", None, "", " \t", "one", "ONE", "one two", "x " * 30_000, "x " * 9]


def test_distance_tells_similarity():
    found = []
    r = random.Random(1)
    for t in texts(n=60)[:60]:
        for share in (0.005, 0.01, 0.02, 0.03, 0.1, 0.5):
            u = " ".join(str(r.random()) if r.random() < share else w for w in t.split())
            (p, k), (q, j) = similar.sketch(t), similar.sketch(u)
            found.append((jaccard(sets(t), sets(u)), np.bitwise_count(p ^ q).sum() <= similar.RADIUS and (k == j).any()))
    like, linked = np.array([f for f, _ in found]), np.array([x for _, x in found])
    assert (like >= 0.8).sum() > 100 and linked[like >= 0.8].mean() >= 0.97
    assert (like < 0.65).sum() > 80 and linked[like < 0.65].mean() <= 0.03


def test_shingles_are_sets_of_words():
    for t in texts(n=10):
        assert len(similar.shingles(t)) == len(sets(t))
    assert (similar.shingles("A b c d e f") == similar.shingles(" a\nB c d\te F ")).all()
    assert len(np.intersect1d(similar.shingles("a b c d e"), similar.shingles("e d c b a"))) == 0


@pytest.mark.parametrize("size", [1, 7, 300, 700])
def test_tiles(size):
    r = np.random.default_rng(size)
    prints = r.integers(0, 1 << 64, (size, 8), dtype=np.uint64)
    for i in range(0, size - 3, 3):  # chains of rows a few bits apart
        for step in (1, 2):
            prints[i + step] = prints[i]
            prints[i + step, :step] ^= np.uint64(0xFFFF)
    for share in (0.0, 0.3, 1.0):
        rest = r.random(size) < share
        near = (np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= 20) & (rest[:, None] | rest[None])
        want = local_roots(size, *np.nonzero(near))
        assert (similar.tile_roots(prints, rest, 20, tile=64) == want).all()


@pytest.mark.parametrize("tile", [2048, 5])
def test_keepers(spark, tile, monkeypatch):
    data = [(i * 3 % 1009, t) for i, t in enumerate(texts())]
    roots = similar.similar_roots
    monkeypatch.setattr(similar, "similar_roots", lambda vertices, radius: roots(vertices, radius, tile))
    docs = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS vertex", "2 AS p0", "3 AS root").repartition(6)
    got = {r.kept_id for r in similar.similar_keepers(docs).collect()}
    made = [similar.sketch(t) for _, t in data]
    prints = np.array([p for p, _ in made])
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    meet = np.array([[len(a) == len(b) and (a == b).any() if len(a) else not len(b) for _, b in made] for _, a in made])
    root = local_roots(len(data), *np.nonzero((near <= similar.RADIUS) & meet))
    assert got == {min(data[i][0] for i in np.flatnonzero(root == r)) for r in set(root)}
    exact = [sets(t) for _, t in data]
    like = np.array([[jaccard(a, b) >= 0.8 for b in exact] for a in exact])
    plain = local_roots(len(data), *np.nonzero(like))
    assert len(got - {min(data[i][0] for i in np.flatnonzero(plain == r)) for r in set(plain)}) <= 1 and len(got) < len(data) - 80


def test_one_large_group_and_a_frequent_passage(spark):
    """Copies by the hundred in one cell, and texts that share half of their words with all others and stay."""
    r = random.Random(9)
    base, shared = [str(r.random()) for _ in range(400)], [f"shared{i}" for i in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        w[r.randrange(400)] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([*shared, *(f"own{i}-{k}" for k in range(120))])) for i in range(200)]
    assert {x.kept_id for x in similar.similar_keepers(spark.createDataFrame(rows, SCHEMA)).collect()} == {0, *range(1000, 1200)}


def test_nothing_and_nulls(spark):
    assert similar.similar_keepers(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None), (4, ""), (3, " "), (None, "a b"), (None, "a b"), (5, "c d"), (5, "e f")]
    got = similar.similar_keepers(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(x.kept_id or -1 for x in got) == [-1, 3, 5, 5]
