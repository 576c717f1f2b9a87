import hashlib
import random

import numpy as np
import pytest

from docstrata.llm.suffixes import remove_repeats


def brute(docs, width):
    """Straight from the definition: strings seen in documents with smaller ids."""
    out, seen = {}, {}
    for doc, text in sorted(docs):
        data = (text or "").encode()
        for i in range(len(data) - width + 1):
            seen.setdefault(data[i : i + width], doc)
    for doc, text in docs:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - width + 1):
            if seen[data[i : i + width]] < doc:
                gone[i : i + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randint(1, 6)))
    passage = [" ".join(word() for _ in range(25)) for _ in range(4)]
    docs = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 20))) for _ in range(3)]
        for p in passage:
            if r.random() < 0.5:
                parts.insert(r.randint(0, len(parts)), p)
        docs.append((i * 3, " ".join(parts)))
        if r.random() < 0.2 and docs:
            docs.append((i * 3 + 1, r.choice(docs)[1]))
        if r.random() < 0.2 and docs:
            t = r.choice(docs)[1]
            docs.append((i * 3 + 2, t[: len(t) // 2] + "#" + t[len(t) // 2 :]))
    return docs + [(100_001, None), (100_002, ""), (100_003, "ab" * 400), (100_004, "ab" * 300 + "c"), (100_005, "x" * 5000), (100_006, "x" * 5000)]


@pytest.mark.parametrize("seed,hot,block_bytes", [(1, 64, 2_500_000), (2, 2, 2_000), (3, 1, 500), (4, 5, 1_000)])
def test_as_by_definition(spark, tmp_path, seed, hot, block_bytes):
    docs = corpus(seed)
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS block", "'x' AS bytes").write.parquet(str(tmp_path / "d"))
    got = remove_repeats(spark.read.parquet(str(tmp_path / "d")), hot=hot, block_bytes=block_bytes).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute(docs, 50)
    assert len(got) == len(docs)


def test_empty_table(spark):
    got = remove_repeats(spark.createDataFrame([], "doc_id long, text string"), keep_text=True)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"] and got.count() == 0


@pytest.mark.parametrize("width", [1, 3, 7, 8, 9, 16, 24, 50])
def test_hashes_tell_strings_apart(width):
    import numpy as np

    from docstrata.llm.suffixes import rolling

    data = np.frombuffer(("abcabcabd" * 40 + "é" * 60 + "x" * 70 + "abcabcabc" * 9).encode(), np.uint8)
    h = rolling(data, width)
    strings = [data[i : i + width].tobytes() for i in range(len(data) - width + 1)]
    assert len(h) == len(strings) and len(set(h.tolist())) == len(set(strings)) == len(set(zip(h.tolist(), strings)))
    assert len(rolling(data[: width - 1], width)) == 0 and len(rolling(data[:width], width)) == 1


def test_only_repeated_windows_are_put_in_order(monkeypatch):
    """The suffix order once held every byte of the pieces; hashes are made in tiles, whose borders change nothing."""
    from docstrata.llm import suffixes

    rng, width = np.random.default_rng(4), 50
    texts = [rng.integers(97, 101, 400, dtype=np.uint8).tobytes() for _ in range(60)]
    texts[40:] = [texts[i][:150] + texts[i + 20][:250] for i in range(20)]
    data, count = np.frombuffer(b"".join(texts), np.uint8), np.full(60, 351)
    doc, at = np.arange(60) // 2, suffixes._window_starts(count, width)
    seen, ranks = [], suffixes.window_ranks
    monkeypatch.setattr(suffixes, "window_ranks", lambda d, some, w: seen.append(len(some)) or ranks(d, some, w))
    least = {}
    for a, d in zip(at.tolist(), np.repeat(doc, 351).tolist()):
        least.setdefault(data[a : a + width].tobytes(), d)
    want = [least[data[a : a + width].tobytes()] < d for a, d in zip(at.tolist(), np.repeat(doc, 351).tolist())]
    for most in (10**6, 500):
        seen.clear()
        assert suffixes.answer_pieces(data, count, doc, width, most).tolist() == want and any(want)
        assert sum(seen) < 0.7 * len(at) and (most > 500 or len(seen) > 5)
    whole = suffixes.Block(np.arange(60), texts, width, 64)
    monkeypatch.setattr(suffixes, "TILE", 129)
    tiled = suffixes.Block(np.arange(60), texts, width, 64)
    assert all(np.array_equal(getattr(whole, n), getattr(tiled, n)) for n in ("start", "stop", "doc", "key", "mark", "piece", "first"))
