import math
from collections import Counter

import public_tokenizers
import pytest

from docstrata.llm.sampling import Lattice, decode_ids, sample_segmentations

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return Lattice(MODEL)


def every(lattice, text):
    """All paths of a one-unit text with their probabilities."""
    steps, out = lattice.unit("▁" + text), []

    def go(at, ids, p):
        if at == len(steps):
            out.append((tuple(ids), p))
            return
        for j, i, w in steps[at]:
            go(j, [*ids, *i], p * math.exp(w))

    go(0, [], 1.0)
    return dict(out)


def test_probabilities_and_first_draws(lattice):
    paths = every(lattice, "then")
    assert abs(sum(paths.values()) - 1) < 1e-9 and len(paths) > 5
    n = 6000
    first = Counter(tuple(lattice.sample("then", 2, s)[0][0]) for s in range(n))
    for ids, p in paths.items():
        assert abs(first[ids] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_inclusion_scores_weigh_to_one(lattice):
    # without replacement, sums of p / inclusion over a sample have mean 1
    sums = [sum(math.exp(p) / q for _, p, q in lattice.sample("then", 3, s)) for s in range(4000)]
    assert abs(sum(sums) / len(sums) - 1) < 0.05


def test_all_segmentations_once(lattice):
    paths = every(lattice, "then")
    got = lattice.sample("then", 10_000, 1)
    assert len(got) == len(paths) == len({tuple(i) for i, _, _ in got}) and all(q == 1 for *_, q in got)


def test_rows(spark):
    texts = ["Hello  world\n\ttab é ☃ 𐍈 ñ. ", None, "", "a", " ", "very " * 3000, "same", "same"]
    rows = [(i if t != "same" else 99, 0, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k long, j long, text string").selectExpr("*", "1 AS ids", "2 AS key_0")
    got = decode_ids(sample_segmentations(df, ["k", "j"], MODEL), MODEL).collect()
    again = sample_segmentations(df.repartition(3), ["k", "j"], MODEL).collect()
    assert sorted((r.k, r.sample, tuple(r.ids)) for r in got) == sorted((r.k, r.sample, tuple(r.ids)) for r in again)
    for k, _, t in rows:
        own = [r for r in got if r.k == k]
        assert all(r.decoded == (t or "") for r in own) and len({tuple(r.ids) for r in own}) == (4 if t and len(t) > 1 else len({tuple(r.ids) for r in own}))
        assert all(0 < r.inclusion <= 1 and r.log_prob <= 1e-9 for r in own)
    assert [(r.ids, r.inclusion) for r in got if r.k == 1] == [([], 1.0)]
    assert sample_segmentations(spark.createDataFrame([], "k long, text string"), ["k"], MODEL).count() == 0


def test_null_keys_and_long_texts(spark):
    import public_tokenizers

    from docstrata.llm.sampling import decode_ids, sample_segmentations

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(None, 1, "a b c"), (None, 1, "a b c"), (2, None, None), (3, 1, "word " * 4_000 + "é")]
    got = decode_ids(sample_segmentations(spark.createDataFrame(rows, "k long, t long, text string").selectExpr("*", "1 AS sample"), ["k", "t"], path, k=2), path).collect()
    same = [r.ids for r in got if r.k is None and r["sample"] == 1]
    assert len(same) == 2 and same[0] == same[1] and [r.ids for r in got if r.k == 2] == [[]]
    assert all(r.decoded == rows[3][2] for r in got if r.k == 3) and sum(r.k == 3 for r in got) == 2
