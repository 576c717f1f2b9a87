"""What the language stage finds decides how the pipeline packs: no sequence mixes languages, whatever the labels lack."""

import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from docstrata.llm.language import learn
from docstrata.llm.packing import pack_documents
from docstrata.llm.queries import tokenizer_path
from tests.llm.test_language import made

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of three languages: one in three has no label, some held-out ones a wrong label; and one label is of a language that is not learnt."""
    truth = {i: (text, lang) for i, text, lang in made(1200)}
    wrong = {"xx": "yy", "yy": "zz", "zz": "xx"}
    label = {i: None if i % 3 == 0 else wrong[lang] if held_out(i) and i % 5 == 0 else lang for i, (_, lang) in truth.items()}
    rows = [(i, text, label[i], "s", len(text)) for i, (text, _) in truth.items()]
    odd = next(i for i in range(5000, 5100) if held_out(i))
    return truth, label, odd, spark.createDataFrame([*rows, (odd, "der und die heit " * 9, "qq", "s", 1)], SCHEMA)


def mixed(pieces, truth):
    by = defaultdict(set)
    for p in pieces:
        by[p.sequence_id].add(truth[p.doc_id][1])
    return sum(len(v) > 1 for v in by.values())


def whole(pieces, length=1024):
    """Each document's pieces and each sequence's offsets leave no gap."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append((p.start, p.length, p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in docs.values():
        ends = [a + n for a, n, _ in sorted(parts)]
        assert [a for a, _, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] == parts[0][2]
    for parts in sequences.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= length
    return len(sequences)


def test_texts_without_a_label_or_with_a_wrong_one_get_the_answer(spark, corpus):
    truth, label, odd, docs = corpus
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert set(got) == set(truth) | {odd} and got[odd] == "qq"
    missing, wrong = ([i for i in truth if f(i)] for f in (lambda i: label[i] is None, lambda i: label[i] not in (None, truth[i][1])))
    assert len(missing) == 400 and len(wrong) > 20
    assert sum(got[i] == truth[i][1] for i in missing) / len(missing) > 0.97
    assert sum(got[i] == truth[i][1] for i in wrong) / len(wrong) > 0.8
    right = [i for i in truth if label[i] == truth[i][1]]
    assert sum(got[i] == truth[i][1] for i in right) / len(right) > 0.99


def test_an_unsure_answer_leaves_the_label(spark, corpus, monkeypatch):
    truth, label, odd, docs = corpus
    monkeypatch.setattr(corpus_pipeline, "SURE", 1.1)
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert all(got[i] == label[i] for i in truth if label[i]) and None not in got.values()


def test_no_sequence_of_the_pipeline_mixes_languages(spark, corpus, tmp_path):
    truth, _, odd, docs = corpus
    docs.where(f"doc_id <> {odd}").write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole(pieces)
    kept = {p.doc_id for p in pieces}
    assert len(kept) > 1000 and mixed(pieces, truth) <= 2
    assert sum(p.lang == truth[p.doc_id][1] for p in pieces) / len(pieces) > 0.97


@pytest.mark.parametrize("most_values,group_pieces", [(256, 50_000), (2, 50_000), (1, 40)])
def test_packing_by_a_column(spark, most_values, group_pieces):
    truth = {i: (text, None if lang == "zz" else lang) for i, text, lang in made(200, seed=3)}
    truth |= {1000: ("", "xx"), 1001: (None, ""), 1002: ("the of and " * 3_000, "yy")}
    docs = spark.createDataFrame([(i, t, v) for i, (t, v) in truth.items()], "doc_id long, text string, value string").repartition(3)
    path = tokenizer_path("byte_bpe_50k.json")
    packed = pack_documents(docs, path, by="value", most_values=most_values, group_pieces=group_pieces)
    assert packed.columns[-1] == "value"
    pieces = packed.collect()
    n = whole(pieces)
    assert all(p.value == truth[p.doc_id][1] for p in pieces) and mixed(pieces, truth) == 0 and {p.doc_id for p in pieces} == set(truth)
    plain = pack_documents(docs, path).collect()
    assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == Counter((p.doc_id, p.doc_tokens) for p in plain if p.start == 0)
    assert "value" not in plain[0].asDict() and (group_pieces < 50_000 or n <= whole(plain) + 4)


def test_nothing_learnt_keeps_the_labels(spark):
    held = [i for i in range(100) if held_out(i)][:2]
    docs = spark.createDataFrame([(held[0], "the of and", "xx", "s", 1), (held[1], "der die und", None, "s", 1)], SCHEMA)
    assert learn(docs) is None
    assert {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, "").collect()} == {held[0]: "xx", held[1]: None}
