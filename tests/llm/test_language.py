import random
import zlib

import pytest

from docstrata.llm.language import ByteNet, cut_windows, identify_languages

WORDS = {"xx": "the of and tion with ing ther".split(), "yy": "der die und heit ung über ßen".split(), "zz": "los que ción para ñas así".split()}


def made(n, seed=0):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(3, 300))), lang) for i in range(n) for lang in [r.choice(sorted(WORDS))]]


def test_held_out_accuracy_and_edges(spark):
    rows = [*made(600), (9001, None, "xx"), (9002, "", None), (9003, "12 34 !", "yy"), (9004, "der und die " * 20_000, None)]
    got = identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'q' AS lang_pred")).collect()
    by, truth = {r.doc_id: r for r in got}, {i: lang for i, _, lang in rows[:600]}
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [i for i in truth if by[i].held_out]
    assert sum(by[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (9001, 9002, 9003))
    assert by[9004].lang_pred == "yy" and all(0 <= r.score <= 1 for r in got)


def test_labels_and_held_out_rows_are_no_input(spark):
    rows = made(300)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = df.selectExpr("doc_id", "text", "IF(crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2, 'xx', lang) AS lang")
    a, b = (sorted(map(tuple, identify_languages(x).collect())) for x in (df, other))
    assert a == b


@pytest.mark.parametrize("rows", [[], [(1, "abc", None)]])
def test_nothing_to_learn_from(spark, rows):
    got = identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * len(rows)


def test_windows_hold_the_whole_text():
    data = bytes(range(1, 256)) * 3
    assert cut_windows(data, 256).tobytes().rstrip(b"\0") == data and len(cut_windows(b"", 256)) == 1


def test_gradients_are_slopes():
    import numpy as np

    net = ByteNet.fit([b"abcd" * 5, b"wxyz" * 5] * 4, ["a", "b"] * 4, window=16, filters=3, epochs=1)
    x, y, w = np.stack([cut_windows(b"abxyz", 16)[0], cut_windows(b"wxab", 16)[0]]), np.array([0, 1]), np.ones(2)
    loss = lambda: -net.log_probabilities(x)[np.arange(2), y].mean()
    for p, g in zip([net.top, net.filters[2]], [net._gradients(x, y, w)[-1], net._gradients(x, y, w)[0]]):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        before, old = loss(), p[i]
        p[i] += 1e-2
        assert abs((loss() - before) / 1e-2 - g[i]) < 0.15 * abs(g[i]) + 1e-3
        p[i] = old
